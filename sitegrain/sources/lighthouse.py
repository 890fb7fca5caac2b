"""Lighthouse result files: scores, metrics, opportunities, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Audits that are opportunities.
OPPORTUNITIES = (
    "unused-css-rules unused-javascript modern-image-formats offscreen-images render-blocking-resources unminified-css unminified-javascript "
    "efficient-animated-content duplicated-javascript legacy-javascript total-byte-weight uses-optimized-images uses-text-compression uses-responsive-images"
).split()
METRICS = {"fcp": "first-contentful-paint", "lcp": "largest-contentful-paint", "si": "speed-index", "tti": "interactive", "tbt": "total-blocking-time", "cls": "cumulative-layout-shift"}
CATEGORIES = {"performance": "performance", "accessibility": "accessibility", "best_practices": "best-practices", "seo": "seo", "pwa": "pwa"}

_AUDIT = "struct<title:string,description:string,score:double,numericValue:double,details:struct<overallSavingsMs:double,overallSavingsBytes:bigint,items:array<struct<resourceType:string,requestCount:bigint,transferSize:bigint>>>>"
SCHEMA = f"requestedUrl string, finalUrl string, userAgent string, categories map<string,struct<score:double>>, audits map<string,{_AUDIT}>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, report) of a folder of result files; the page is the file's stem, unreadable files are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("page_id"), "value")
    return parse(raw, "value")


def parse(rows: DataFrame, column: str) -> DataFrame:
    parsed = rows.withColumn("report", F.from_json(column, SCHEMA, {"mode": "PERMISSIVE"}))
    return parsed.drop(column).filter(F.col("report.audits").isNotNull() | F.col("report.categories").isNotNull())


def _score(name: str) -> Column:
    """Times 100, to one decimal."""
    return F.floor(F.try_element_at("report.categories", F.lit(name))["score"] * 1000 + 0.5) / 10


def scores(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """One row a report: five scores, six metrics; a missing PWA score is 0."""
    columns = [(F.coalesce(_score(v), F.lit(0.0)) if k == "pwa" else _score(v)).alias(f"lighthouse_{k}") for k, v in CATEGORIES.items()]
    values = [F.try_element_at("report.audits", F.lit(v))["numericValue"].alias(f"lighthouse_{k}") for k, v in METRICS.items()]
    return parsed.select(key, F.col("report.requestedUrl").alias("requested_url"), F.col("report.finalUrl").alias("final_url"), *columns, *values)


def opportunities(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, id, title, savings_ms, savings_bytes, items) of the opportunity audits that have details."""
    rows = parsed.select(key, F.explode("report.audits").alias("id", "a")).filter(F.col("id").isin(*OPPORTUNITIES) & F.col("a.details").isNotNull())
    return rows.select(key, "id", "a.title", F.col("a.details.overallSavingsMs").alias("savings_ms"), F.col("a.details.overallSavingsBytes").alias("savings_bytes"), F.size("a.details.items").alias("items"))


def diagnostics(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, dom_size, requests, main_thread_ms, resources map): zero sizes count as unknown."""
    audit = lambda n: F.try_element_at("report.audits", F.lit(n))
    positive = lambda v: F.nullif(v, F.lit(0.0))
    items = audit("resource-summary")["details"]["items"]
    resources = F.map_from_entries(F.transform(F.array_distinct(F.transform(items, lambda i: F.coalesce(i["resourceType"], F.lit("unknown")))), lambda k: F.struct(k.alias("key"), F.filter(items, lambda i: F.coalesce(i["resourceType"], F.lit("unknown")) == k)[0]["transferSize"].alias("value"))))
    return parsed.select(key, positive(audit("dom-size")["numericValue"]).alias("dom_size"), F.greatest(F.coalesce(F.size(audit("network-requests")["details"]["items"]), F.lit(0)), F.lit(0)).alias("requests"), positive(audit("mainthread-work-breakdown")["numericValue"]).alias("main_thread_ms"), resources.alias("resources"))


def screenshots(rows: DataFrame, column: str, key: str = "page_id") -> DataFrame:
    """(key, pos, item) of the thumbnails of a raw report, items as JSON."""
    items = F.from_json(F.get_json_object(column, "$.audits.screenshot-thumbnails.details.items"), "array<string>")
    return rows.select(key, F.posexplode(items).alias("pos", "item"))


def write_reports(parsed: DataFrame, path: str, key: str = "page_id") -> None:
    """Scores, metrics and opportunities of every report as JSON lines below ``path``, one folder each."""
    scores(parsed, key).write.mode("overwrite").json(f"{path}/scores")
    opportunities(parsed, key).write.mode("overwrite").json(f"{path}/opportunities")
    diagnostics(parsed, key).write.mode("overwrite").json(f"{path}/diagnostics")
