"""Technical issues as rows, their totals, the page matrix and the prioritised report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..thresholds import DEFAULTS, Thresholds

#: Priority of each issue in reports.
PRIORITIES = {
    "missing_description": "critical",
    "missing_title": "critical",
    "duplicate_title": "high",
    "missing_h1": "high",
    "multiple_h1": "medium",
    "images_without_alt": "high",
    "slow_page": "high",
    "thin_content": "medium",
    "missing_canonical": "medium",
    "short_description": "medium",
    "long_description": "medium",
    "short_title": "medium",
    "long_title": "medium",
    "broken_links": "high",
}
PRIORITY_ORDER = {"critical": 0, "high": 1, "medium": 2}


def blank(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) == ""


def _issue(name: str, measured: Column, severity) -> Column:
    level = severity if isinstance(severity, Column) else F.lit(severity)
    return F.struct(F.lit(name).alias("issue_type"), measured.cast("double").alias("measured"), level.alias("severity"))


def page_issues(t: Thresholds = DEFAULTS) -> Column:
    """array<struct<issue_type, measured, severity>> of a page row; all checks but those across pages."""
    title, description = F.col("title"), F.col("description")
    n_title, n_description = F.length(title), F.length(description)
    n_h1 = F.coalesce(F.size("h1_tags"), F.lit(0))
    words = F.coalesce(F.col("word_count"), F.lit(0))
    return F.array_compact(
        F.array(
            F.when(blank(title), _issue("missing_title", F.lit(0), "critical")),
            F.when(~blank(title) & (n_title < t.title_min), _issue("short_title", n_title, "warning")),
            F.when(~blank(title) & (n_title > t.title_max), _issue("long_title", n_title, "warning")),
            F.when(blank(description), _issue("missing_description", F.lit(0), "critical")),
            F.when(~blank(description) & (n_description < t.description_min), _issue("short_description", n_description, "warning")),
            F.when(~blank(description) & (n_description > t.description_max), _issue("long_description", n_description, "warning")),
            F.when(n_h1 == 0, _issue("missing_h1", F.lit(0), "critical")),
            F.when(n_h1 > 1, _issue("multiple_h1", n_h1, "warning")),
            F.when(F.col("images_without_alt") > 0, _issue("images_without_alt", F.col("images_without_alt"), F.when(F.col("images_without_alt") >= t.images_without_alt_critical, "critical").otherwise("warning"))),
            F.when(F.col("load_time") > t.slow_seconds, _issue("slow_page", tx.round_half_up(F.col("load_time"), 2), F.when(F.col("load_time") > t.slow_seconds_critical, "critical").otherwise("warning"))),
            F.when(words < t.thin_words, _issue("thin_content", words, F.when(words <= t.thin_words_critical, "critical").otherwise("warning"))),
            F.when(blank(F.col("canonical_url")), _issue("missing_canonical", F.lit(0), "warning")),
        )
    )


def extension_issues() -> Column:
    """Checks the page table allows beyond the classic list: viewport, language, https, structured data."""
    return F.array_compact(
        F.array(
            F.when(blank(F.col("viewport")), _issue("missing_viewport", F.lit(0), "warning")),
            F.when(blank(F.col("lang")), _issue("missing_lang", F.lit(0), "warning")),
            F.when(~urls.is_https(F.col("url")), _issue("non_https", F.lit(0), "critical")),
            F.when(F.coalesce(F.size("schema_types"), F.lit(0)) == 0, _issue("missing_structured_data", F.lit(0), "warning")),
        )
    )


def issue_rows(pages: DataFrame, thresholds: Thresholds = DEFAULTS, extensions: bool = False) -> DataFrame:
    """(url, crawl_seq, issue_type, measured, severity), one row an issue; duplicate titles included."""
    found = F.concat(page_issues(thresholds), extension_issues()) if extensions else page_issues(thresholds)
    own = pages.select("url", "crawl_seq", F.explode(found).alias("i")).select("url", "crawl_seq", "i.*")
    twins = duplicate_titles(pages).select("title", "pages", "severity")
    shared = pages.select("url", "crawl_seq", "title").join(twins, "title").select("url", "crawl_seq", F.lit("duplicate_title").alias("issue_type"), F.col("pages").cast("double").alias("measured"), "severity")
    return own.unionByName(shared)


def duplicate_titles(pages: DataFrame) -> DataFrame:
    """(title, pages, severity) of titles on several pages; critical unless there are exactly two."""
    counted = pages.filter(~blank(F.col("title"))).groupBy("title").agg(F.count(F.lit(1)).alias("pages")).filter("pages > 1")
    return counted.withColumn("severity", F.when(F.col("pages") == 2, "warning").otherwise("critical"))


def issue_totals(issues: DataFrame) -> DataFrame:
    """(issue_type, pages, critical)."""
    return issues.groupBy("issue_type").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("severity") == "critical").alias("critical"))


def issue_samples(issues: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows of each issue in crawl order."""
    order = Window.partitionBy("issue_type").orderBy("crawl_seq", "url")
    return issues.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def prioritised(issues: DataFrame) -> DataFrame:
    """(issue_type, priority, pages), most urgent first, then most frequent."""
    spark: SparkSession = issues.sparkSession
    dim = spark.createDataFrame([(k, v, PRIORITY_ORDER[v]) for k, v in PRIORITIES.items()], "issue_type string, priority string, _order int")
    counted = issues.groupBy("issue_type").agg(F.count(F.lit(1)).alias("pages"))
    return counted.join(F.broadcast(dim), "issue_type").orderBy("_order", F.desc("pages"), "issue_type").drop("_order")


def page_flags(t: Thresholds = DEFAULTS) -> Column:
    """The eleven flags of a page matrix row.  Security asks for https and three known headers."""
    return F.array_compact(
        F.array(
            F.when(blank(F.col("title")), "title"),
            F.when(blank(F.col("description")), "desc"),
            F.when(F.coalesce(F.size("h1_tags"), F.lit(0)) <= 0, "h1"),
            F.when(blank(F.col("canonical_url")), "canonical"),
            F.when(F.coalesce(F.col("word_count"), F.lit(0)) < t.thin_words, "thin"),
            F.when(F.col("load_time") > t.slow_seconds, "slow"),
            F.when(F.col("lighthouse_performance") < 50, "perf"),
            F.when(F.col("images_without_alt") > 0, "alt"),
            F.when(~urls.is_https(F.col("url")) | (F.coalesce(F.size(F.map_keys("headers")), F.lit(0)) < 3), "security"),
            F.when(F.size("console_errors") > 0, "errors"),
            F.when(F.col("was_redirected"), "redirect"),
        )
    )


def page_matrix(pages: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """(url, title, flags, n_flags, health, accessibility), worst first, then by url."""
    a11y = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("images_without_alt", "buttons_without_aria", "links_without_context", "inputs_without_labels")), F.lit(0))
    shown = F.when(blank(F.col("title")), "(No title)").when(F.length("title") > 60, F.concat(F.substring("title", 1, 60), F.lit("..."))).otherwise(F.col("title"))
    rows = pages.select("url", shown.alias("title"), page_flags(thresholds).alias("flags"), a11y.alias("accessibility"))
    n = F.size("flags")
    return rows.select("url", "title", "flags", n.alias("n_flags"), F.greatest(F.lit(0), 100 - n * 10).alias("health"), "accessibility").orderBy(F.desc("n_flags"), "url")
