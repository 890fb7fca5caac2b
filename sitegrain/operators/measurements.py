"""Joins between a crawl and its page-speed measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = (
    "lighthouse_performance", "lighthouse_accessibility", "lighthouse_best_practices", "lighthouse_seo", "lighthouse_lcp", "lighthouse_fcp", "lighthouse_cls", "lighthouse_tbt",
    "crux_lcp_percentile", "crux_fid_percentile", "crux_cls_percentile",
)


def unmeasured(pages: DataFrame, measured: DataFrame, key: str = "url") -> DataFrame:
    """Pages without a measurement."""
    return pages.join(measured.select(key).distinct(), key, "left_anti")


def fill_missing(entries: DataFrame, source: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """``entries`` with null cells of ``columns`` taken from ``source``; ``filled`` counts them.

    Of several source rows of a key the first by its values is taken.
    """
    one = source.groupBy(key).agg(F.min(F.struct(*columns)).alias("_s"))
    joined = entries.join(one, key, "left")
    taken = sum((F.when(F.col(c).isNull() & F.col(f"_s.{c}").isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))
    others = [c for c in entries.columns if c not in columns]
    return joined.select(*others, *[F.coalesce(F.col(c), F.col(f"_s.{c}")).alias(c) for c in columns], taken.alias("filled"))


def overwrite(entries: DataFrame, source: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """``entries`` with ``columns`` of ``source`` wherever it has a row, nulls included."""
    one = source.groupBy(key).agg(F.min(F.struct(*columns)).alias("_s"))
    joined = entries.join(one, key, "left")
    others = [c for c in entries.columns if c not in columns]
    return joined.select(*others, *[F.when(F.col("_s").isNotNull(), F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def coverage(pages: DataFrame, measured: DataFrame, key: str = "url") -> DataFrame:
    """(pages, sampled, succeeded, failed, skipped, share, enough): ``measured`` has (key, ok)."""
    seen = pages.select(key).join(measured.groupBy(key).agg(F.bool_or("ok").alias("ok")), key, "left")
    found = seen.agg(F.count(F.lit(1)).alias("pages"), F.count("ok").alias("sampled"), F.count_if("ok").alias("succeeded"))
    share = F.coalesce(F.try_divide(F.col("succeeded") * 100.0, F.col("sampled")), F.lit(0.0))
    return found.select("*", (F.col("sampled") - F.col("succeeded")).alias("failed"), (F.col("pages") - F.col("sampled")).alias("skipped"), share.alias("share"), (share >= 90).alias("enough"))


def sample_pages(pages: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Home pages, and about ``rate`` of the others (one at least), chosen by a hash of the URL."""
    home = pages.filter(F.regexp_replace("url", r"^[^/]*//[^/?#]*", "").isin("", "/"))
    others = pages.join(home.select("url"), "url", "left_anti")
    n = max(1, int(others.count() * rate))
    return home.unionByName(others.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "url")), "url").limit(n).select(*pages.columns))
