"""Request logs: rolling metrics, adaptive delay, token bucket, health of contexts and proxies, retries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify

#: The rolling window, and the rules of the adaptive delay.
WINDOW_ROWS, LEAST_ROWS = 20, 3
ERROR_RATE, BACK_OFF, TARGET_SECONDS, RECOVERY, MIN_DELAY, MAX_DELAY, FIRST_DELAY = 0.1, 2.0, 2.0, 0.9, 0.5, 10.0, 2.0


def rolling_metrics(log: DataFrame, by: str = "domain", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """``log`` (by, order columns, response_time, success) with the mean response and error rate of the last 20 rows."""
    last = Window.partitionBy(by).orderBy(*order).rowsBetween(-(WINDOW_ROWS - 1), 0)
    n = F.count(F.lit(1)).over(last)
    return log.withColumns({"window_rows": n, "avg_response": F.avg("response_time").over(last), "error_rate": F.sum(F.when(F.col("success"), 0.0).otherwise(1.0)).over(last) / n})


def next_delay(delay: float, n: int, avg_response: float, error_rate: float) -> float:
    """The delay after a request: doubled on errors, raised when slow, lowered when quick and faultless."""
    if n < LEAST_ROWS:
        return delay
    if error_rate > ERROR_RATE:
        delay *= BACK_OFF
    elif avg_response > TARGET_SECONDS:
        delay *= min(avg_response / TARGET_SECONDS, 2.0)
    elif error_rate == 0 and avg_response < TARGET_SECONDS * 0.5:
        delay *= RECOVERY
    return max(MIN_DELAY, min(MAX_DELAY, delay))


def adaptive_delay(log: DataFrame, by: str = "domain", order: tuple[str, ...] = ("ts", "seq"), first: float = FIRST_DELAY) -> DataFrame:
    """:func:`rolling_metrics` with ``delay``, the value in force after each request.

    A fold over the ordered rows of each key.  The rows stream through the task, sorted by the shuffle, and only the
    current key's delay is held: a hot key costs time, not memory.
    """
    measured = rolling_metrics(log, by, order)
    ordered = measured.repartition(by).sortWithinPartitions(by, *order)
    schema = measured.schema.add("delay", "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, delay = None, first
        for batch in batches:
            out = []
            for k, n, avg, rate in zip(batch[by], batch["window_rows"], batch["avg_response"], batch["error_rate"]):
                if k != key:
                    key, delay = k, first
                delay = next_delay(delay, n, avg, rate)
                out.append(delay)
            yield batch.assign(delay=out)

    return ordered.mapInPandas(run, schema)


def token_bucket(log: DataFrame, rate: float, capacity: float, by: str = "domain", ts: str = "ts", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """``log`` with ``wait``, the seconds each request waits for its token, in order of arrival.

    Request k can leave when, counted from every earlier request i, its tokens are refilled:
    wait = max over i <= k of (k - i + 1 - capacity) / rate - (t_k - t_i), at least 0.  A running minimum gives it.
    """
    w = Window.partitionBy(by).orderBy(*order)
    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    started = at - F.min(at).over(Window.partitionBy(by))
    number = F.row_number().over(w)
    rows = log.withColumn("_t", started).withColumn("_n", number)
    least = F.min(F.col("_n") - 1 - F.col("_t") * rate).over(w.rowsBetween(Window.unboundedPreceding, 0))
    wait = (F.col("_n") - least - capacity) / rate - F.col("_t")
    return rows.withColumn("wait", F.greatest(F.lit(0.0), wait)).drop("_t", "_n")


def gaps(log: DataFrame, by: str = "domain", ts: str = "ts", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """``log`` with the seconds since the request before, null for the first of a key."""
    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    return log.withColumn("gap", at - F.lag(at).over(Window.partitionBy(by).orderBy(*order)))


def context_health(log: DataFrame, by: str = "context", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """``log`` (by, order, success) with ``health``: judged at errors only, and kept between them.

    Above half errors unhealthy, above a fifth degraded, else the state before; healthy at first.
    """
    w = Window.partitionBy(by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rate = F.sum(F.when(F.col("success"), 0.0).otherwise(1.0)).over(upto) / F.count(F.lit(1)).over(upto)
    state = F.when(~F.col("success") & (rate > 0.5), "unhealthy").when(~F.col("success") & (rate > 0.2), "degraded")
    return log.withColumn("_state", state).withColumn("health", F.coalesce(F.last("_state", ignorenulls=True).over(upto), F.lit("healthy"))).drop("_state")


def proxy_health(log: DataFrame, by: str = "proxy", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """``log`` (by, order, success, blocked) with ``health`` of each proxy after every use.

    Five failures in a row make it unhealthy, two degraded, three blocks retired; a degraded one is healthy again at
    a success rate above 0.9.  The rows stream in order; six numbers a key are held.
    """
    ordered = log.repartition(by).sortWithinPartitions(by, *order)
    schema = log.schema.add("health", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total, good, row, blocks, health = None, 0, 0, 0, 0, "healthy"
        for batch in batches:
            out = []
            for k, ok, blocked in zip(batch[by], batch["success"], batch["blocked"]):
                if k != key:
                    key, total, good, row, blocks, health = k, 0, 0, 0, 0, "healthy"
                total += 1
                if ok:
                    good, row = good + 1, 0
                    if health == "degraded" and good / total > 0.9:
                        health = "healthy"
                else:
                    row += 1
                    blocks += bool(blocked)
                    health = "unhealthy" if row >= 5 else "degraded" if row >= 2 else health
                    health = "retired" if blocks >= 3 else health
                out.append(health)
            yield batch.assign(health=out)

    return ordered.mapInPandas(run, schema)


def use_statistics(log: DataFrame, by: str) -> DataFrame:
    """(by, uses, success_rate, avg_ms over successes, error_rate); rates of nothing are 1 and 0."""
    good = F.count_if("success")
    return log.groupBy(by).agg(F.count(F.lit(1)).alias("uses"), F.coalesce(F.try_divide(good, F.count(F.lit(1))), F.lit(1.0)).alias("success_rate"), F.avg(F.when(F.col("success"), F.col("response_time") * 1000)).alias("avg_ms"), F.coalesce(F.try_divide(F.count_if(~F.col("success")), F.count(F.lit(1))), F.lit(0.0)).alias("error_rate"))


def pool_status(states: DataFrame) -> DataFrame:
    """(health, members) of the last state of every member (by, seq, health)."""
    last = states.groupBy("member").agg(F.max_by("health", "seq").alias("health"))
    return last.groupBy("health").agg(F.count(F.lit(1)).alias("members"))


def failures(log: DataFrame) -> DataFrame:
    """The last failure of each URL: (url, error cut at 500, retries, retryable)."""
    bad = log.filter(~F.col("success"))
    last = bad.groupBy("url").agg(F.max_by("error", "seq").alias("error"), F.count(F.lit(1)).alias("retries"))
    return last.select("url", F.substring("error", 1, 500).alias("error"), "retries", classify.is_retryable(F.coalesce("error", F.lit("")), F.col("retries")).alias("retryable"))


def failures_by_type(log: DataFrame) -> DataFrame:
    return log.filter(~F.col("success")).groupBy("error_type").agg(F.count(F.lit(1)).alias("failures"))


def not_expired(entries: DataFrame, as_of) -> DataFrame:
    """Rows whose expires_at is not before ``as_of``."""
    return entries.filter(F.col("expires_at") >= F.lit(as_of))


def evict_oldest(entries: DataFrame, max_bytes: int) -> DataFrame:
    """The newest rows (created_at, key, bytes) whose running size stays within ``max_bytes``.

    Days are summed apart first, so the running sum over all rows is a window over days and one inside each day.
    """
    day = F.to_date("created_at")
    days = entries.groupBy(day.alias("_day")).agg(F.sum("bytes").alias("_b"))
    newer = Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = days.select("_day", F.coalesce(F.sum("_b").over(newer), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_day").orderBy(F.desc("created_at"), "key").rowsBetween(Window.unboundedPreceding, 0)
    placed = entries.withColumn("_day", day).withColumn("_own", F.sum("bytes").over(inside)).join(offsets, "_day")
    return placed.filter(F.col("_before") + F.col("_own") <= max_bytes).select(*entries.columns)
