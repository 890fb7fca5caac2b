"""Streaming forms: adaptive delay with state, deduplication of URLs, windowed request metrics.

Windows and watermarks are an extension: the batch operators know no event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.requests import FIRST_DELAY, WINDOW_ROWS, next_delay


def adaptive_delay(log: DataFrame, by: str = "domain", order: str = "seq", first: float = FIRST_DELAY) -> DataFrame:
    """(by, order, delay) after every request of a stream (by, order, response_time, success).

    The state of a key is its delay and last 20 outcomes.  Within a micro-batch rows go by ``order``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        delay, times, oks = state.get if state.exists else (first, [], [])
        times, oks = list(times), list(oks)
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for t, ok in zip(rows["response_time"], rows["success"]):
            times, oks = [*times, float(t)][-WINDOW_ROWS:], [*oks, bool(ok)][-WINDOW_ROWS:]
            delay = next_delay(delay, len(times), sum(times) / len(times), oks.count(False) / len(oks))
            out.append(delay)
        state.update((delay, times, oks))
        yield pd.DataFrame({by: key[0], order: rows[order], "delay": out})

    kinds = {f.name: f.dataType.simpleString() for f in log.schema.fields}
    return log.groupBy(by).applyInPandasWithState(step, f"{by} {kinds[by]}, {order} {kinds[order]}, delay double", "delay double, times array<double>, oks array<boolean>", "append", GroupStateTimeout.NoTimeout)


def first_seen(urls: DataFrame, watermark: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Each URL once within the watermark."""
    return urls.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["url"])


def windowed_metrics(log: DataFrame, by: str = "domain", ts: str = "ts", size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests, error rate and mean response by key and tumbling window."""
    grouped = log.withWatermark(ts, late).groupBy(by, F.window(ts, size).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("requests"), F.avg(F.when(F.col("success"), 0.0).otherwise(1.0)).alias("error_rate"), F.avg("response_time").alias("avg_response")).select(by, F.col("w.start").alias("start"), "requests", "error_rate", "avg_response")


def start(rows: DataFrame, path: str, checkpoint: str, mode: str = "append", on_batch=None):
    """Write a stream as Parquet, or hand every micro-batch to ``on_batch(df, epoch)``; resumes at its checkpoint."""
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(on_batch).start() if on_batch else writer.format("parquet").option("path", path).start()
