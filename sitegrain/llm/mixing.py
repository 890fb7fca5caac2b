"""Mixing sources to target weights by weighted fair queueing.

Every source queues its documents in a shuffled order, as often as its share needs.  A document's virtual finish
time is the number of words its source has queued up to its end, divided by the source's target.  Serving the
queues in the order of these times keeps all sources on their targets at every moment, and at virtual time 1 every
source has given exactly its target and the total budget is spent: there the mix is truncated, and a document in
service at that moment is cut to the words it had left.

That this is the truncation of the global order at the total budget: in the order of finish times, the turns that
finish by time 1 come first, and their words are the whole turns below each source's target, together no more than the
budget.  No turn that starts at 1 or later is served by then.  What is left of the budget is, source by source, what
the one turn that starts before 1 and ends after it still has to give, and it goes to these turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, free_prefix, materialize

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2
#: Queued documents in one bucket of the prefix sums, about.
BUCKET_ROWS = 2_000


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with weight and target.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``budget`` times all words; a target
    stops at ``most`` times its source's words and the excess is shared again by weight.  That fixed point is the
    water level at which least(cap, level * weight) sums to the budget: with sources in the order of cap / weight,
    the level is the largest of (budget - caps before) / (weights from here).  One row a source is all it handles.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * most
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * F.lit(float(budget)) - before) / after
    leveled = sizes.withColumn("weight", weight).withColumn("level", level)
    return leveled.select("source", "source_size", "weight", F.least(cap.cast("double"), F.max("level").over(everything) * F.col("weight")).alias("target"))


def schedule(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: str = "mix:") -> DataFrame:
    """One row for every row of ``docs`` (doc_id, text, source): row identity, sizes and its turns in the mix.

    Columns: doc_id, source, text_hash, size, source_size, target, taken, turns array<struct<turn, start, finish,
    words>> (virtual times).  The shuffle is md5 of the id, so reruns agree.  Prefix sums run in buckets of the
    shuffled order, so that a source with a third of all rows is cut into many tasks.
    """
    plain = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"))
    mixed = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = materialize(plain.withColumn("mixed", mixed), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    targets = source_targets(sources, weights, budget, most).join(sources.select(F.col("source").alias("_s"), "rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    targets = materialize(targets.withColumn("buckets", F.ceil(F.col("rows") / BUCKET_ROWS)), "targets").withColumnRenamed("source", "_source")
    share = F.conv(F.substring("mixed", 1, 8), 16, 10).cast("double") / float(1 << 32)
    placed = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("bucket", F.floor(share * F.col("buckets")))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), earlier.alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("mixed", F.col("doc_id").asc_nulls_last(), "text_hash", "size")
    queued = placed.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    queued = queued.withColumn("queue", F.col("offset") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    allotted = F.floor("target").cast("long")

    def turn(n):
        start = F.col("queue") + F.col("source_size") * n
        words = F.greatest(F.lit(0), F.least(F.col("size"), allotted - start))
        return F.struct(F.lit(n + 1).alias("turn"), (start / F.col("target")).alias("start"), ((start + F.col("size")) / F.col("target")).alias("finish"), words.alias("words"))

    turns = F.filter(F.when(F.col("target") > 0, F.array(*[turn(n) for n in range(most)])).otherwise(F.array()), lambda t: t["words"] > 0)
    rows = queued.withColumn("turns", turns)
    taken = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["words"])
    return rows.select("doc_id", "source", "text_hash", "size", "source_size", "target", taken.alias("taken"), "turns")


def in_mix_order(scheduled: DataFrame) -> DataFrame:
    """The rows in the global order of their first virtual finish time, by range partitions; untaken rows last."""
    first = F.coalesce(F.try_element_at("turns", F.lit(1))["finish"], F.lit(float("inf")))
    return scheduled.withColumn("first", first).repartitionByRange("first", "doc_id").sortWithinPartitions("first", "doc_id").drop("first")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``.

    Null texts and texts without words have size 0 and are never taken; null sources are a source, the last; null
    ids take part, first in no order of their own; repeated rows count each; no words at all give targets of 0;
    an empty table gives no rows; further columns are ignored.
    """
    return in_mix_order(schedule(docs, **options)).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as mixed: a row for every turn of a document, in the order of virtual finish times, with its own
    columns.  The one document a source that the budget cuts keeps as many of its words as were taken.

    Null texts and texts without words are never taken; null sources are a source; null ids take part; rows that repeat
    are taken each for itself; an empty table gives no rows; helper columns never clash with those of ``docs``.
    """
    scheduled = materialize(schedule(docs, **options), "schedule")
    twins = scheduled.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() > 0
    # rows that agree in id and text are told apart by a number, which takes a shuffle of the texts of its own
    number = lambda *key, by: F.row_number().over(Window.partitionBy(*key).orderBy(*by)) if twins else F.lit(1)
    turns = scheduled.withColumn("n", number("doc_id", "text_hash", by=("source", "size"))).select("doc_id", "text_hash", "n", "size", F.explode("turns").alias("t"))
    p = free_prefix(docs)
    named = {"id": "doc_id", "hash": "text_hash", "m": "n", "size": "size", "finish": "t.finish", "words": "t.words"}
    turns = turns.select(*[F.col(v).alias(p + k) for k, v in named.items()])
    helper = {k: F.col(p + k) for k in (*named, "text", "n")}
    numbered = docs.withColumn(p + "text", F.xxhash64("text"))
    numbered = numbered.withColumn(p + "n", number("doc_id", p + "text", by=(F.col("source").cast("string"),)))
    joined = numbered.join(turns, F.col("doc_id").eqNullSafe(helper["id"]) & (helper["text"] == helper["hash"]) & (helper["n"] == helper["m"]))
    pieces = F.slice(F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, helper["words"].cast("int"))
    short = helper["words"] < helper["size"]
    cut = joined.withColumn("text", F.when(short, F.array_join(pieces, "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(short, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.repartitionByRange(p + "finish", "doc_id").sortWithinPartitions(p + "finish", "doc_id").select(*docs.columns)
