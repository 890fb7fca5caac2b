"""Report tables and texts.  A text is a table of lines and their places, which :func:`.sinks.write_lines` writes in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import site, technical

#: Rows that a report shows of one issue.
SHOWN = 5


def status_flags() -> Column:
    """What a crawl prints beside a page: title, description, h1, thin."""
    return F.array_compact(
        F.array(
            F.when(technical.blank(F.col("title")), "no title"),
            F.when(technical.blank(F.col("description")), "no description"),
            F.when(F.coalesce(F.size("h1_tags"), F.lit(0)) <= 0, "no h1"),
            F.when(F.coalesce(F.col("word_count"), F.lit(0)) < 300, "thin"),
        )
    )


def issue_lines(issues: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(place, no, line): every issue with its number of pages, the most frequent first, and its first pages in crawl
    order; a last line says how many pages are not shown.  No issues give no lines."""
    order = Window.orderBy(F.desc("pages"), "issue_type")  # a row an issue type
    totals = technical.issue_totals(issues).withColumn("place", F.row_number().over(order))
    pages, critical = F.col("pages").cast("string"), F.col("critical").cast("string")
    heads = totals.select("place", F.lit(0).alias("no"), F.concat("issue_type", F.lit(": "), pages, F.lit(" pages, "), critical, F.lit(" critical")).alias("line"))
    measured = F.regexp_replace(F.col("measured").cast("decimal(20,2)").cast("string"), r"\.?0+$", "")
    sampled = technical.issue_samples(issues, shown).join(totals.select("issue_type", "place"), "issue_type")
    listed = sampled.select("place", F.col("rank").alias("no"), F.concat(F.lit("  - "), "url", F.lit(" ("), F.coalesce(measured, F.lit("-")), F.lit(", "), "severity", F.lit(")")).alias("line"))
    rest = totals.filter(F.col("pages") > shown).select("place", F.lit(shown + 1).alias("no"), F.concat(F.lit("  ... and "), (F.col("pages") - shown).cast("string"), F.lit(" more")).alias("line"))
    return heads.unionByName(listed).unionByName(rest)


def issue_report(issues: DataFrame, shown: int = SHOWN) -> str:
    """The lines of :func:`issue_lines` as one text; their number is bounded by the issue types."""
    return "\n".join(r.line for r in issue_lines(issues, shown).orderBy("place", "no").collect())


def crawl_lines(pages: DataFrame, start_url: str) -> DataFrame:
    """(section, no, line) of a crawl's summary: 0 where it began, 1 its numbers, 2 every page in crawl order with what
    it lacks.  A crawl without pages has its head and their number, 0."""
    summary = site.crawl_summary(pages)
    numbers = F.explode(F.array(*[F.struct(F.lit(1).alias("section"), F.lit(n).cast("long").alias("no"), F.concat(F.lit(f"{c}: "), number_text(F.col(c))).alias("line")) for n, c in enumerate(summary.columns, 1)]))
    head = F.array(F.struct(F.lit(0).alias("section"), F.lit(0).cast("long").alias("no"), F.lit(f"crawl of {start_url}").alias("line")))
    top = summary.select(F.explode(head).alias("l")).unionByName(summary.select("pages", numbers.alias("l")).filter("pages > 0 OR l.no = 1").select("l")).select("l.*")
    lacks = F.array_join(status_flags(), ", ")
    line = F.concat(F.lit("- "), "url", F.when(lacks != "", F.concat(F.lit(" ["), lacks, F.lit("]"))).otherwise(""))
    return top.unionByName(pages.select(F.lit(2).alias("section"), F.col("crawl_seq").cast("long").alias("no"), line.alias("line")))


def format_number(value) -> str:
    """Thousands separated; nothing as a dash."""
    return "-" if value is None else f"{value:,}" if isinstance(value, int) else f"{value:,.2f}"


def number_text(value: Column, digits: int = 0) -> Column:
    """Thousands separated, with so many digits after the point; null as a dash."""
    return F.coalesce(F.format_number(value, digits), F.lit("-"))


def size_text(size: Column) -> Column:
    """Bytes as B, KB or MB, with one digit from a kilobyte on, halves to the even digit; null as a dash."""
    kb, mb = F.format_string("%.1f KB", F.bround(size / 1024, 1)), F.format_string("%.1f MB", F.bround(size / (1024 * 1024), 1))
    return F.when(size < 1024, F.format_string("%d B", size)).when(size < 1024 * 1024, kb).when(size.isNotNull(), mb).otherwise("-")


def domain_text(url: Column) -> Column:
    """The host of an address without www; the address itself where it has none."""
    host = F.regexp_extract(url, r"^[^/]*//(?:www\.)?([^/?#]*)", 1)
    return F.when(host != "", host).otherwise(url)


#: What makes a section of a report worth a look, by the row of its summary.
WORTH_A_LOOK = {
    "resources": lambda: (F.col("bloated") > 0) | (F.col("heavy_js") > 0) | (F.col("heavy_css") > 0),
    "social": lambda: (F.col("og_coverage") < 80) | (F.col("twitter_coverage") < 80),
    "redirects": lambda: (F.col("three_plus") > 0) | (F.col("longest") > 3),
    "third_parties": lambda: (F.col("share") > 30) | (F.col("avg_requests") > 20),
    "console": lambda: F.col("errors") > 0,
    "images": lambda: (F.col("alt_share") < 90) | (F.col("modern_share") < 50),
}


def section(summary: DataFrame, kind: str, sizes: tuple[str, ...] = ()) -> DataFrame:
    """A row of a summary as a report shows it: ``enabled`` (it has pages), ``has_issues``, and byte columns ``sizes`` as text."""
    worth = F.coalesce(WORTH_A_LOOK[kind](), F.lit(False))
    enabled = F.coalesce(F.col("pages") > 0, F.lit(False))
    return summary.withColumns({"enabled": enabled, "has_issues": enabled & worth} | {f"{c}_text": size_text(F.col(c)) for c in sizes})


def first_rows(rows: DataFrame, by: list[str], order: list[Column], n: int = 10) -> DataFrame:
    """The first ``n`` rows of every ``by`` with their place, and how many rows there are in all."""
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= n)
    return ranked.join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("of")), by)


def format_date(value: Column) -> Column:
    return F.date_format(value, "MMMM d, yyyy HH:mm")


def crawl_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd_HHmmss")


def parse_date(text: Column, otherwise: Column) -> Column:
    """ISO text as a timestamp; ``otherwise`` where it is none."""
    return F.coalesce(F.try_to_timestamp(text), otherwise)


def console_pages(rows: DataFrame, pages: int = 20, messages: int = 5) -> DataFrame:
    """(url, errors, messages) of the pages with most errors, first messages each; ties in crawl order."""
    counted = rows.groupBy("url", "crawl_seq").agg(F.count(F.lit(1)).alias("errors")).orderBy(F.desc("errors"), "crawl_seq", "url").limit(pages)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("pos"))).filter(F.col("_n") <= messages)
    listed = first.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "message"))), lambda x: x["message"]).alias("messages"))
    return counted.join(listed, "url").select("url", "errors", "messages", "crawl_seq").orderBy(F.desc("errors"), "crawl_seq", "url").drop("crawl_seq")


def social_extremes(rows: DataFrame, best: int = 5, worst: int = 10) -> tuple[DataFrame, DataFrame]:
    """The best pages with any score, and the worst pages, of ``site.social_rows``."""
    scored = rows.withColumn("score", F.col("og_score") + F.col("twitter_score"))
    return scored.filter("score > 0").orderBy(F.desc("score"), "crawl_seq").limit(best), scored.orderBy("score", "crawl_seq").limit(worst)


def phase_totals(rows: DataFrame, phases: str = "timing") -> DataFrame:
    """(phase, pages, seconds) of a map column of durations."""
    return rows.select(F.explode(phases).alias("phase", "s")).groupBy("phase").agg(F.count(F.lit(1)).alias("pages"), F.sum("s").alias("seconds"))


def hit_rate(lookups: DataFrame) -> DataFrame:
    """(lookups, hits, rate) of a log with a boolean ``hit``."""
    return lookups.agg(F.count(F.lit(1)).alias("lookups"), F.count_if("hit").alias("hits"), F.coalesce(F.try_divide(F.count_if("hit"), F.count(F.lit(1))), F.lit(0.0)).alias("rate"))


def resumable(states: DataFrame) -> DataFrame:
    """Paused crawls (domain, crawl_ts, status), newest first."""
    return states.filter(F.col("status") == "paused").orderBy(F.desc("crawl_ts"), "domain")


def is_safe_target(url: Column, stop_words: tuple[str, ...]) -> Column:
    """Whether an address holds none of the stop words."""
    return ~F.exists(F.array(*[F.lit(w.lower()) for w in stop_words]), lambda w: F.contains(F.lower(url), w))
