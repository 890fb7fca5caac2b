"""The state of a crawl as a stream: which URLs are queued, visited or failed, kept in a map that survives restarts.

Events are (domain, url, event): found, visited or failed.  The URLs of a domain are dealt over shards, so that a
large domain is the state of many tasks; where URLs are forgotten after a time, a shard holds a map from URL to status and
attempts, else every URL is a key of a streaming aggregate.  What a restarted
query emits continues what it emitted before, because state and position are one checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SHARDS, ATTEMPTS = 32, 3
SCHEMA = "domain string, url string, status string, attempts int"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class UrlStates(StatefulProcessor):
    """A row for every URL whose state a micro-batch changes.

    A URL is visited once any event says so, failed after ``attempts`` failures without a visit, and queued until then;
    so the last row of a URL is the same in whatever order and batches its events come.  Where ``keep`` is given, a URL that
    has not changed for so many milliseconds is forgotten.
    """

    def __init__(self, attempts: int = ATTEMPTS, keep: int | None = None):
        self.attempts, self.keep = attempts, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.urls = handle.getMapState("urls", "url string", "status string, attempts int", self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed: dict[str, tuple[str, int]] = {}
        for batch in rows:
            for url, event in zip(batch["url"], batch["event"]):
                if url is None:
                    continue
                before = changed.get(url)
                if before is None and self.urls.containsKey((url,)):
                    before = tuple(self.urls.getValue((url,)))
                status, attempts = before or (None, 0)
                attempts += event == "failed"
                if event == "visited" or status == "visited":
                    status = "visited"
                else:
                    status = "failed" if attempts >= self.attempts else "queued"
                if (status, attempts) != before:
                    changed[url] = status, attempts
        for url, state in changed.items():
            self.urls.updateValue((url,), state)
        if changed:
            yield pd.DataFrame({"domain": key[0], "url": list(changed), "status": [s for s, _ in changed.values()], "attempts": pd.Series([a for _, a in changed.values()], dtype="int32")})

    def close(self) -> None:
        pass


def url_states(events: DataFrame, shards: int = SHARDS, attempts: int = ATTEMPTS, keep: int | None = None) -> DataFrame:
    """(domain, url, status, attempts) as they change, of a stream (domain, url, event).  A null domain is one of its own.

    Without ``keep`` the state of a URL is an aggregate of its events, which Spark keeps by itself, and a micro-batch gives
    a row for every URL that it names; ``shards`` then has no meaning.  The session needs the RocksDB state store, see
    :func:`prepare`.
    """
    if keep is None:
        told = events.filter("url is not null").groupBy(F.coalesce("domain", F.lit("")).alias("domain"), "url")
        counted = told.agg(F.max(F.coalesce(F.col("event") == "visited", F.lit(False))).alias("seen"), F.count_if(F.col("event") == "failed").cast("int").alias("attempts"))
        status = F.when(F.col("seen"), "visited").when(F.col("attempts") >= attempts, "failed").otherwise("queued")
        return counted.select("domain", "url", status.alias("status"), "attempts")
    keyed = events.select(F.coalesce("domain", F.lit("")).alias("domain"), F.pmod(F.xxhash64("url"), F.lit(shards)).cast("int").alias("shard"), "url", "event")
    return keyed.groupBy("domain", "shard").transformWithStateInPandas(UrlStates(attempts, keep), SCHEMA, "Update", "processingTime")


def prepare(spark: SparkSession) -> None:
    """Let a session keep map states."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def latest(changes: DataFrame) -> DataFrame:
    """The last state of every URL among all changes: visits outlast failures, attempts only grow."""
    rank = F.when(F.col("status") == "visited", 2).when(F.col("status") == "failed", 1).otherwise(0)
    best = changes.groupBy("domain", "url").agg(F.max(F.struct(rank.alias("rank"), "attempts", "status")).alias("s"), F.max("attempts").alias("attempts"))
    return best.select("domain", "url", "s.status", "attempts")


def resume_point(changes: DataFrame) -> DataFrame:
    """(domain, status, queued, visited, failed): what an interrupted crawl has left; paused while something is queued, else done."""
    n = lambda s: F.count_if(F.col("status") == s)
    counted = latest(changes).groupBy("domain").agg(n("queued").alias("queued"), n("visited").alias("visited"), n("failed").alias("failed"))
    return counted.select("domain", F.when(F.col("queued") > 0, "paused").otherwise("done").alias("status"), "queued", "visited", "failed")
