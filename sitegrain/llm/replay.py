"""Reassembly of a transaction log with savepoints.

A log record belongs to a stream, whose transactions follow one another; each ends with a commit, an abort or the log.
Rollbacks are paired with the savepoints they return to, as brackets are, which gives intervals of the log that they
undo; a range join finds for every change the first rollback whose interval holds it; what survives and is committed
is reduced to one row a key and epoch, and the states of the store are running sums over those.

No step walks a transaction: the number of open savepoints is a running sum less its running minimum, so it
is also found where one transaction fills most of the log (see :mod:`prefix`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .prefix import in_slices, running

EPOCH_COMMITS = 64
KEYS = 30_000


def log_records(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(lsn, stream, op, key, value) as ``documents`` spell a log: the value is a digest of key and text, null deletes.

    Rows without an id have no place in the log.  Texts are read once and go no further than their digest; an id with
    contrary labels counts as toxic.
    """
    toxic = labels.filter(F.col("toxic") == 1).select(F.col("doc_id").alias("_id")).distinct()
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    part, key = h % 17, F.floor(h / 100).cast("long") % KEYS
    op = F.when(part <= 1, "commit").when(part == 2, "abort").when(part <= 4, "savepoint").when(part <= 6, "rollback").otherwise("change")
    digest = F.crc32(F.concat(key.cast("string"), F.lit(":"), F.col("text").cast("string")).cast("binary"))
    narrow = docs.filter("doc_id is not null").select(F.col("doc_id").alias("lsn"), F.col("source").cast("string").alias("stream"), op.alias("op"), F.when(part > 6, key).alias("key"), F.when(part > 6, digest).alias("value"))
    joined = narrow.join(toxic, F.col("lsn") == F.col("_id"), "left")
    return joined.select("lsn", "stream", "op", "key", F.when(F.col("_id").isNull(), F.col("value")).alias("value"))


def placed(log: DataFrame, epoch_commits: int = EPOCH_COMMITS) -> DataFrame:
    """The log with ``pos``, its place from 1, ``epoch`` of its commits, and ``end``: the record that ends its transaction.

    Records of one ``lsn`` go by stream (null first), operation, key and value; the order of equal ones is of no effect.
    """
    stream = F.coalesce(F.concat(F.lit("="), F.col("stream")), F.lit(""))
    order = ["lsn", "stream", "op", "key", "value", "n"]
    sliced = in_slices(log.select("lsn", stream.alias("stream"), "op", "key", "value").withColumn("n", F.monotonically_increasing_id()), *order, tag="log")
    numbered = running(sliced, [], order, pos=(F.sum, F.lit(1)), commits=(F.sum, (F.col("op") == "commit").cast("long")))
    epoch = F.when(F.col("op") == "commit", F.floor((F.col("commits") - 1) / epoch_commits) + 1)
    numbered = materialize(numbered.withColumn("epoch", epoch.cast("long")).drop("n", "commits"), "numbered")
    discard(sliced)
    end = F.when(F.col("op").isin("commit", "abort"), F.struct("pos", "op", "lsn", "epoch"))
    ended = materialize(running(numbered, ["stream"], ["pos"], reverse=True, end=(F.min, end)), "ended")
    discard(numbered)
    return ended.withColumn("txn", F.coalesce(F.col("end.pos"), F.lit(0)))


def bracketed(records: DataFrame) -> DataFrame:
    """``records`` with ``level``: the savepoints open at a change; which of them a savepoint is, from 1; which a
    rollback returns to, 0 for the start of its transaction."""
    step = F.when(F.col("op") == "savepoint", 1).when(F.col("op") == "rollback", -1).otherwise(0)
    inside = records.filter(~F.col("op").isin("commit", "abort")).withColumn("step", step)
    summed = materialize(running(inside, ["stream", "txn"], ["pos"], total=(F.sum, F.col("step"))), "summed")
    least = running(summed, ["stream", "txn"], ["pos"], inclusive=False, least=(F.min, F.col("total")))
    open_before = F.col("total") - F.col("step") - F.least(F.lit(0), F.col("least"))
    level = F.when(F.col("op") == "savepoint", open_before + 1).otherwise(open_before)
    found = materialize(least.withColumn("level", level).drop("step", "total", "least"), "levels")
    discard(summed)
    return found


def fates(records: DataFrame) -> DataFrame:
    """(lsn, pos, key, value, kind, undone_by, epoch, commit): every change of :func:`placed` records.

    ``kind`` is rollback, abort or null where the change is stored; ``undone_by`` the lsn that undid it, null at the
    log's end; ``epoch`` and ``commit`` (its place) are those of the commit that stores it.

    Undo intervals of one level do not overlap, since a savepoint of a level can only follow the rollback that removed
    the one before; so a change lies in that of the next rollback of its level or in none, and no level further out
    can undo it earlier.
    """
    group = ["stream", "txn", "level"]
    levels = bracketed(records)
    savepoint = F.when(F.col("op") == "savepoint", F.col("pos"))
    paired = materialize(running(levels, group, ["pos"], start=(F.max, savepoint)), "paired")
    discard(levels)
    start = F.when(F.col("level") == 0, F.lit(0)).otherwise(F.col("start"))
    interval = F.when(F.col("op") == "rollback", F.struct("pos", start.alias("start"), "lsn"))
    held = running(paired, group, ["pos"], reverse=True, undo=(F.min, interval)).filter("op = 'change'")
    undone = F.col("undo").isNotNull() & (F.col("undo.start") < F.col("pos"))
    stored = ~undone & F.coalesce(F.col("end.op") == "commit", F.lit(False))
    kind = F.when(undone, "rollback").when(~stored, "abort")
    by = F.when(undone, F.col("undo.lsn")).when(~stored, F.col("end.lsn"))
    found = held.select("lsn", "pos", "key", "value", kind.alias("kind"), by.alias("undone_by"), F.when(stored, F.col("end.epoch")).alias("epoch"), F.when(stored, F.col("end.pos")).alias("commit"))
    out = materialize(found, "fates")
    discard(paired)
    return out


def states(changes: DataFrame, epochs: DataFrame) -> DataFrame:
    """(epoch, n, value): stored keys and the sum of their values after each of ``epochs`` (epoch).

    A key's last change of an epoch stands for all of them; its effect is the difference from the key's state before.
    """
    last = changes.filter("epoch is not null").groupBy("key", "epoch").agg(F.max(F.struct("commit", "pos", "value")).alias("last"))
    by_key = in_slices(last.select(F.coalesce("key", F.lit(-1)).alias("key"), "epoch", F.col("last.value").alias("value")), "key", "epoch", tag="reduced")
    known = running(by_key, ["key"], ["epoch"], inclusive=False, before=(F.max, F.struct("epoch", "value")))
    count = lambda c: F.col(c).isNotNull().cast("long")
    amount = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    steps = known.select("epoch", (count("value") - count("before.value")).alias("n"), (amount("value") - amount("before.value")).alias("value"))
    none = F.lit(0).cast("long")
    every = steps.unionByName(epochs.select("epoch", none.alias("n"), none.alias("value")).distinct()).groupBy("epoch").agg(F.sum("n").alias("dn"), F.sum("value").alias("dvalue"))
    by_epoch = in_slices(every, "epoch", tag="epochs")
    discard(by_key)
    return running(by_epoch, [], ["epoch"], n=(F.sum, F.col("dn")), value=(F.sum, F.col("dvalue"))).select("epoch", "n", "value")


def reassemble(log: DataFrame, epoch_commits: int = EPOCH_COMMITS) -> DataFrame:
    """(kind, id, n, value): a ``state`` after every epoch of ``log`` (lsn, stream, op, key, value), and every undone change.

    A null stream is one of its own, a null key a key like any other, a null value deletes; records without an lsn take
    no part; records that repeat are each replayed; a log without commits has no states, an empty one no rows.
    """
    records = placed(log.filter("lsn is not null"), epoch_commits)
    changes = fates(records)
    epochs = records.filter("epoch is not null").select("epoch").distinct()
    after = states(changes, epochs).select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), "n", "value")
    undone = changes.filter("kind is not null").select("kind", F.col("lsn").alias("id"), F.col("undone_by").alias("n"), F.col("key").alias("value"))
    return after.unionByName(undone)
