"""Benchmark contamination by winnowing, with DataFrame functions only.

Of every ``w`` neighbouring k-grams of words the one with the smallest hash is kept as a fingerprint, in documents
and benchmark items alike, with k + w - 1 no more than the shortest span that counts.  Two texts that share such a
span share all its k-grams, hence a fingerprint at the same place of it: no span can be missed.  Items shorter than a
window are winnowed in classes by their own length, so that one short item does not make the fingerprints of all others
dense.  Shared fingerprints give diagonals (document position less item position); along each diagonal the words themselves are compared, so a
hash collision adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii, materialize

WINDOW = 13
#: Benchmark fingerprints (24 bytes each) and hashes of texts that share one (8 bytes) are broadcast up to this many;
#: beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: The words of all items are broadcast up to this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20
#: Least words of the classes of items that are shorter than a window.
SHORT_SPANS = (1, 2, 4, 7)
#: ASCII other than 0-9 and a-z divides words.
_DIVIDER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), _DIVIDER), "")


#: Low bits of a packed fingerprint that hold its position; no row can hold as many words.
POSITION_BITS = 28


def winnow(words: Column, k: int, w: int) -> Column:
    """The fingerprints of a word array: the leftmost smallest hash of every ``w`` k-grams, each once.

    A fingerprint is one long, hash bits above position bits.  Words are reached by index, never by slices, so the
    work is linear in the text.
    """
    keep = -(1 << POSITION_BITS)

    def grams(x):
        return F.transform(F.sequence(F.lit(0), F.size(x) - k), lambda i: F.xxhash64(*[F.get(x, i + j) for j in range(k)]).bitwiseAND(F.lit(keep).cast("long")).bitwiseOR(i.cast("long")))

    def smallest(g):
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(g) - w, F.lit(0))), lambda i: F.least(*[F.get(g, i + j) for j in range(w)], F.get(g, i)))

    def once(m):
        return F.filter(m, lambda x, i: ~x.eqNullSafe(F.get(m, i - 1)))

    return let(words, lambda x: F.when(F.size(x) < k, F.array().cast("array<bigint>")).otherwise(let(let(grams(x), smallest), once)))


def _unpacked(fingerprint: Column) -> tuple[Column, Column]:
    return F.shiftright(fingerprint, POSITION_BITS).alias("h"), fingerprint.bitwiseAND(F.lit((1 << POSITION_BITS) - 1).cast("long")).cast("int")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs`` (doc_id, text).

    A window is ``window`` consecutive words of an item, or the whole of a shorter one.  ``n_hit`` counts the words
    of the document inside any occurrence of a window, ``n_items`` the items with one; a document is contaminated
    when n_hit > 0 and share * n_hit >= n_words.  Null and empty texts have no words; items without words are never
    found; items without an id count as one item, which the list leaves out; repeated rows give a row each; either table may be empty; further columns are ignored.
    """
    key = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    items = materialize(benchmark.select("item_id", words_of(F.col("text")).alias("item")).filter(F.size("item") > 0).distinct(), "items")
    spans = [n for n in SHORT_SPANS if n < window] + [window]
    span = F.lit(spans[0])
    for n in spans[1:]:
        span = F.when(F.size("item") >= n, n).otherwise(span)
    items = items.withColumn("span", span)
    sized = items.groupBy("span").agg(F.sum(F.octet_length(F.array_join("item", " ")) + F.size("item") * 16)).collect()  # a row a class at most
    present, light = sorted(r[0] for r in sized), sum(r[1] for r in sized) <= BROADCAST_BYTES

    def fingerprints(words):
        """Struct column c of every class that is present: span and fs, its fingerprints."""
        chosen = [(n, (n + 1) // 2) for n in present]
        return F.explode(F.array(*[F.struct(F.lit(n).alias("span"), winnow(words, k, n - k + 1).alias("fs")) for n, k in chosen]).cast("array<struct<span:int,fs:array<bigint>>>"))

    h, at = _unpacked(F.col("f"))
    own = items.select("item_id", "item", "span", fingerprints(F.col("item")).alias("c")).filter("span = c.span").select("item_id", "item", "span", F.explode("c.fs").alias("f"))
    marks = materialize(own.select("item_id", F.xxhash64("item").alias("version"), "span", h, at.alias("ipos")), "marks")
    small = marks.count() <= BROADCAST_ROWS

    short = F.xxhash64(F.col("text").cast("string"))
    texts = docs.select(key.alias("key"), short.alias("short"), words_of(F.col("text")).alias("words"))
    placed = texts.select("short", "key", fingerprints(F.col("words")).alias("c")).select("short", "key", "c.span", F.explode("c.fs").alias("f")).select("key", "short", "span", h, at.alias("dpos"))
    seeds = placed.join(F.broadcast(marks) if small else marks, ["h", "span"]).select("key", "short", "item_id", "version", (F.col("dpos") - F.col("ipos")).alias("diagonal")).distinct()
    seeds = materialize(seeds, "seeds")

    # only texts with a seed move, once each; where too many have one to broadcast their hashes, the join shuffles
    wanted = seeds.select("short").distinct()
    few = wanted.count() <= BROADCAST_ROWS
    moved = docs.select(F.col("text").cast("string").alias("text"), short.alias("short")).join(F.broadcast(wanted) if few else wanted, "short", "left_semi")
    found = moved.select(key.alias("key"), "text").dropDuplicates(["key"]).select("key", words_of(F.col("text")).alias("words"))
    known = items.select("item_id", F.xxhash64("item").alias("version"), "item")
    same_item = F.col("s.item_id").eqNullSafe(F.col("i.item_id")) & (F.col("s.version") == F.col("i.version"))
    aligned = seeds.drop("short").join(found, "key").alias("s").join((F.broadcast(known) if light else known).alias("i"), same_item).select("s.*", "i.item")
    size = F.least(F.lit(window), F.size("item"))
    equal = F.transform("item", lambda x, j: (j + F.col("diagonal") >= 0) & F.coalesce(F.get(F.col("words"), j + F.col("diagonal")) == x, F.lit(False)))

    def inside(same):
        """Item positions that lie in a run of at least ``size`` equal words."""
        runs = F.regexp_extract_all(F.array_join(F.transform(same, lambda x: F.when(x, "1").otherwise("0")), ""), F.lit("1+|0+"), F.lit(0))
        long = F.array_join(F.transform(runs, lambda r: F.when(F.length(r) < size, F.repeat(F.lit("0"), F.length(r))).otherwise(r)), "")
        return let(F.split(long, ""), lambda c: F.filter(F.sequence(F.lit(0), F.size("item") - 1), lambda j: F.get(c, j) == "1"))

    hit = aligned.select("key", "item_id", "diagonal", let(equal, inside).alias("inside")).filter(F.size("inside") > 0)
    hit = hit.select("key", "item_id", F.transform("inside", lambda j: j + F.col("diagonal")).alias("at"))
    by_text = hit.groupBy("key").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("found"), F.max(F.col("item_id").isNull().cast("int")).alias("unnamed"))
    by_text = materialize(by_text, "hits")  # written, so that the join can split the rows of a text with many copies
    rows = docs.select("doc_id", key.alias("key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("found", F.array().cast("array<string>"))
    return rows.join(by_text, "key", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        (F.size(listed) + F.coalesce("unnamed", F.lit(0))).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """``docs`` without the rows whose text is contaminated; rows of equal text share the decision."""
    judged = docs.select(F.struct("doc_id", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("key")).alias("doc_id"), "text")
    bad = contamination(judged, benchmark, window, share).filter("contaminated").select("doc_id.key").distinct()
    own = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    return docs.join(bad, own == bad["key"], "left_anti")
