"""Queries over findings as a report words and shows them; importing the module adds them to the slate.

Rows built by arithmetic on the given tables stand for measurements, in SQL that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vitals
from ..operators import advice, evidence, measurements, reports, selectors, sinks
from ..sources.shared import scratch_path
from ..streaming import requests as streams
from .slate import _query, _r, _sql_r, _table

# -- insights and evidence ---------------------------------------------------------------------------------------------------

_MEASURED = """SELECT p_partkey AS id, p_partkey % 5 AS pages, CASE p_partkey % 3 WHEN 0 THEN 'optimistic' WHEN 1 THEN 'pessimistic' ELSE 'aligned' END AS tendency, p_partkey % 4 AS mismatches,
CAST(CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey % 9 * 700 END AS DOUBLE) AS lab_lcp, CAST(p_partkey % 7 * 900 AS DOUBLE) AS field_lcp,
CAST(p_partkey % 6 * 150 AS DOUBLE) AS lab_tbt, CAST(p_partkey % 5 * 100 AS DOUBLE) AS field_fid FROM {part}"""


def _band(value: str, good: float, poor: float) -> str:
    return f"CASE WHEN {value} <= {good} THEN 'good' WHEN {value} <= {poor} THEN 'needs-improvement' WHEN {value} IS NOT NULL THEN 'poor' END"


_BANDS = {"lab_lcp": (2500, 4000), "field_lcp": (2500, 4000), "lab_tbt": (200, 600), "field_fid": (100, 300)}


@_query(f"""WITH m AS ({_MEASURED.replace("{part}", "part")}),
s AS (SELECT *, {", ".join(f"{_band(c, *b)} AS {c}_status" for c, b in _BANDS.items())} FROM m)
SELECT id, CASE WHEN pages = 0 THEN 'No page has both laboratory and field data: measure more pages, or wait for visitors.' ELSE array_to_string(list_filter([
CASE tendency WHEN 'optimistic' THEN 'On ' || pages || ' pages the laboratory is faster than visitors find it: slow networks and weak devices are missing there.'
WHEN 'pessimistic' THEN 'On ' || pages || ' pages visitors find it faster than the laboratory: caches or a delivery network serve them.' END,
CASE WHEN mismatches > 0 THEN mismatches || ' of ' || pages || ' pages differ in status between laboratory and field: begin with them.' END,
CASE WHEN lab_lcp_status <> field_lcp_status THEN format('Largest contentful paint is {{}} in the laboratory ({{}} ms) and {{}} in the field ({{}} ms).', lab_lcp_status, CAST(lab_lcp AS BIGINT), field_lcp_status, CAST(field_lcp AS BIGINT)) END,
CASE WHEN lab_tbt_status <> field_fid_status THEN format('Blocking time is {{}} in the laboratory ({{}} ms) and input delay {{}} in the field ({{}} ms): scripts run there that the laboratory does not see.', lab_tbt_status, CAST(lab_tbt AS BIGINT), field_fid_status, CAST(field_fid AS BIGINT)) END],
lambda x: x IS NOT NULL), ' | ') END AS insights FROM s""")
def lab_field_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comparisons of laboratory and field say, with their values; parts stand for sites."""
    rows = spark.sql(_MEASURED, part=_table(spark, sf_dir, "part"))
    status = {f"{c}_status": vitals.band(F.col(c), *b) for c, b in _BANDS.items()}
    return rows.withColumns(status).select("id", F.array_join(advice.lab_field_advice(), " | ").alias("insights"))


_MARKUP = """SELECT 'https://h/' || p_partkey AS url, CAST(CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 8 * 0.6 END AS DOUBLE) AS load_time, p_partkey % 4 AS lcp_candidates,
p_partkey % 6 AS blocking_scripts, p_partkey % 9 AS cls_risks, p_partkey % 3 AS render_blocking, p_partkey % 2 AS lazy_opportunities FROM {part}"""
_LCP = f"coalesce({_band('nullif(load_time, 0) + 0.5', 2.5, 4)}, {_band('lcp_candidates', 0, 2)})"
_STATUSES = f"s AS (SELECT *, {_LCP} AS lcp, {_band('blocking_scripts', 0, 3)} AS inp, {_band('cls_risks', 0, 5)} AS cls FROM m)"


@_query(f"""WITH m AS ({_MARKUP.replace("{part}", "part")}), {_STATUSES}
SELECT url, array_to_string(list_filter([
CASE WHEN lcp <> 'good' THEN 'Largest contentful paint is ' || lcp || coalesce(' at about ' || format('{{:.1f}}', nullif(load_time, 0) + 0.5) || ' seconds', ' by its ' || lcp_candidates || ' candidates') || ': give the main image its size and preload it, in several widths.' END,
CASE WHEN inp <> 'good' THEN 'Interaction is ' || inp || ' with ' || blocking_scripts || ' scripts in its way: load them with async or defer, and cut long tasks.' END,
CASE WHEN cls <> 'good' THEN 'Layout shift is ' || cls || ' with ' || cls_risks || ' elements that may move: give images and frames their size, and keep room for what comes late.' END,
CASE WHEN render_blocking > 0 THEN render_blocking || ' resources hold up rendering: inline the critical ones and load the rest later.' END,
CASE WHEN lazy_opportunities > 0 THEN lazy_opportunities || ' images could be loaded lazily.' END], lambda x: x IS NOT NULL), ' | ') AS insights FROM s""")
def vitals_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do about the vitals of every page, with their values; parts stand for pages."""
    rows = spark.sql(_MARKUP, part=_table(spark, sf_dir, "part"))
    known = rows.withColumns({"lcp": vitals.lcp_status(F.col("load_time"), F.col("lcp_candidates")), "inp": vitals.inp_status(F.col("blocking_scripts")), "cls": vitals.cls_status(F.col("cls_risks")), "lcp_seconds": vitals.lcp_estimate(F.col("load_time"))})
    return known.select("url", F.array_join(advice.vitals_advice(), " | ").alias("insights"))


@_query(f"""WITH m AS ({_MARKUP.replace("{part}", "part")}), {_STATUSES}
SELECT url, finding, {_sql_r("measured")} AS measured, status, good, poor, 'Estimate' AS confidence, 'heuristic' AS source_type, methodology, factors FROM (
SELECT url, 'lcp_estimate' AS finding, CAST(nullif(load_time, 0) + 0.5 AS DOUBLE) AS measured, lcp AS status, 2.5::DOUBLE AS good, 4.0::DOUBLE AS poor, 'response time and rendering' AS methodology, CASE WHEN load_time IS NULL THEN 1 ELSE 2 END AS factors FROM s
UNION ALL SELECT url, 'inp_estimate', blocking_scripts, inp, 0, 3, 'blocking scripts', 1 FROM s
UNION ALL SELECT url, 'cls_estimate', cls_risks, cls, 0, 5, 'elements without a size', 1 FROM s)""")
def vitals_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the estimated vitals of every page, with what went into them."""
    found = evidence.vitals_estimates(spark.sql(_MARKUP, part=_table(spark, sf_dir, "part")))
    return found.withColumns({"factors": F.size("factors"), "measured": _r("measured")})


_USES = "FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL AND kind IS NOT NULL AND click_id IS NOT NULL"


@_query(f"""WITH e AS (SELECT kind AS site, client_id AS purpose, click_id % 3 AS selector, ts, click_id % 7 <> 0 AS ok {_USES}),
c AS (SELECT site, purpose, selector, count(*) FILTER (ok) AS s, count(*) FILTER (NOT ok) AS f, max(ts) FILTER (ok) AS good, max(ts) FILTER (NOT ok) AS bad, max(ts) AS used FROM e GROUP BY ALL),
l AS (SELECT *, (s + 2) / (s + f + 3) * CASE WHEN bad > good THEN 0.95::DOUBLE ELSE 1 END AS confidence, datediff('second', used, TIMESTAMP '2024-06-01') // 86400 AS days FROM c),
t AS (SELECT count(*) AS selectors, count(*) FILTER (days >= 30 AND days < 90) AS stale, count(*) FILTER (days >= 90) AS expired, count(*) FILTER (confidence < 0.5) AS low, avg(confidence) AS a, count(DISTINCT site) AS sites FROM l)
SELECT selectors, stale, expired, low, {_sql_r("a")} AS avg_confidence, sites, coalesce(nullif(array_to_string(list_filter([
CASE WHEN expired > 0 THEN 'remove_expired' END, CASE WHEN stale > selectors * 0.2 THEN 'revalidate_stale' END, CASE WHEN low > selectors * 0.1 THEN 'review_low' END], lambda x: x IS NOT NULL), ','), ''), 'healthy') AS rules FROM t""")
def selector_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lifecycle of selectors and what it asks for; clicks stand for uses of selectors."""
    uses = spark.sql(f"SELECT kind AS site, client_id AS purpose, click_id % 3 AS selector, CAST(ts AS TIMESTAMP) AS ts, click_id % 7 <> 0 AS success {_USES.replace('clicks', '{clicks}')}", clicks=_table(spark, sf_dir, "clicks"))
    found = selectors.lifecycle_report(selectors.from_events(uses), "2024-06-01")
    return found.withColumns({"rules": F.array_join("rules", ","), "avg_confidence": _r("avg_confidence")})


# -- samples and streams -------------------------------------------------------------------------------------------------------


@_query("""WITH c AS (SELECT CASE WHEN page_id % 50 = 0 THEN regexp_extract(url, '^[^/]*//[^/?#]*', 0) || '/' ELSE url END AS url FROM pages),
k AS (SELECT url, regexp_replace(url, '^[^/]*//[^/?#]*', '') IN ('', '/') AS home FROM c),
o AS (SELECT url, row_number() OVER (ORDER BY md5('0:' || url), url) AS n, count(*) OVER () AS total FROM k WHERE NOT home)
SELECT url FROM k WHERE home UNION ALL SELECT url FROM o WHERE n <= greatest(1, CAST(floor(total * 0.25::DOUBLE) AS BIGINT))""")
def measured_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that a quarter's sample of a crawl measures: home pages, and others by the hash of their address."""
    pages = _table(spark, sf_dir, "pages")
    home = F.concat(F.regexp_extract("url", "^[^/]*//[^/?#]*", 0), F.lit("/"))
    return measurements.sample_pages(pages.select(F.when(F.col("page_id") % 50 == 0, home).otherwise(F.col("url")).alias("url")), 0.25)


@_query("SELECT DISTINCT coalesce(kind, '-') || '/' || coalesce(CAST(client_id AS VARCHAR), '-') AS url FROM clicks WHERE ts IS NOT NULL")
def first_seen_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address once, of a stream that is started twice and remembers what it has seen; clicks stand for discoveries."""
    source, sink, checkpoint = (scratch_path(spark, t) for t in ("found", "seen", "checkpoint"))
    url = F.concat_ws("/", F.coalesce("kind", F.lit("-")), F.coalesce(F.col("client_id").cast("string"), F.lit("-")))
    rows = _table(spark, sf_dir, "clicks").filter("ts is not null").select(url.alias("url"), F.col("ts").cast("timestamp").alias("ts"), "click_id")
    spark.createDataFrame([], "url string").write.parquet(sink)  # there may be none at all
    for part in (True, False):
        rows.filter((F.coalesce(F.col("click_id"), F.lit(0)) % 2 == 0) == part).drop("click_id").write.mode("append").parquet(source)
        stream = spark.readStream.schema("url string, ts timestamp").parquet(source)
        streams.start(streams.first_seen(stream, "400 days").select("url"), sink, checkpoint).awaitTermination()
    return spark.read.schema("url string").parquet(sink)


# -- texts and pages of a report -----------------------------------------------------------------------------------------------


@_query(r"""SELECT o_orderkey AS id, format('{:,}', o_orderkey * 37) AS number, format('{:,.2f}', o_orderkey * 12.25::DOUBLE) AS amount, strftime(o_orderdate, '%B %-d, %Y %H:%M') AS day, strftime(o_orderdate, '%Y-%m-%d_%H%M%S') AS crawl,
CASE WHEN o_orderkey % 7 = 0 THEN '-' WHEN o_orderkey % 5 = 0 THEN format('{} B', o_orderkey % 1000) WHEN o_orderkey % 5 < 3 THEN format('{:.1f} KB', (o_orderkey % 500) * 512 / 1024.0 + 1) ELSE format('{:.1f} MB', (o_orderkey % 500) / 2.0 + 1) END AS size,
CASE o_orderkey % 3 WHEN 0 THEN 'h' || o_orderkey || '.example' WHEN 1 THEN 'x.example' ELSE 'plain' END AS domain,
CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '2024-01-02 03:04:05' ELSE o_orderdate END AS parsed FROM orders""")
def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, sizes, dates and hosts as a report words them; orders stand for what is reported."""
    k = F.col("o_orderkey")
    size = F.when(k % 7 == 0, None).when(k % 5 == 0, k % 1000).when(k % 5 < 3, (k % 500) * 512 + 1024).otherwise((k % 500) * 524288 + 1048576)
    url = F.when(k % 3 == 0, F.concat(F.lit("https://www.h"), k.cast("string"), F.lit(".example/a?b"))).when(k % 3 == 1, F.lit("http://x.example")).otherwise("plain")
    date = F.col("o_orderdate")
    parsed = reports.parse_date(F.when(k % 2 == 0, "2024-01-02T03:04:05").otherwise("no date"), date.cast("timestamp"))
    return _table(spark, sf_dir, "orders").select(k.alias("id"), reports.number_text(k * 37).alias("number"), reports.number_text(k * 12.25, 2).alias("amount"), reports.format_date(date).alias("day"), reports.crawl_id(date).alias("crawl"), reports.size_text(size).alias("size"), reports.domain_text(url).alias("domain"), parsed.cast("timestamp_ntz").alias("parsed"))


@_query("""WITH s AS (SELECT s_suppkey AS id, s_suppkey % 3 AS pages, s_suppkey % 2 AS bloated, CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS heavy_js, 0 AS heavy_css, s_suppkey * 700 AS total_bytes FROM supplier)
SELECT id, pages > 0 AS enabled, pages > 0 AND (bloated > 0 OR heavy_js > 0) AS has_issues,
CASE WHEN total_bytes < 1024 THEN total_bytes || ' B' WHEN total_bytes < 1048576 THEN format('{:.1f} KB', total_bytes / 1024.0::DOUBLE) ELSE format('{:.1f} MB', total_bytes / 1048576.0::DOUBLE) END AS total_bytes_text FROM s""")
def report_section_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether sections are shown and have issues, with sizes as text; suppliers stand for sites."""
    k = F.col("s_suppkey")
    rows = _table(spark, sf_dir, "supplier").select(k.alias("id"), (k % 3).alias("pages"), (k % 2).alias("bloated"), F.when(k % 5 == 0, 1).otherwise(0).alias("heavy_js"), F.lit(0).alias("heavy_css"), (k * 700).alias("total_bytes"))
    return reports.section(rows, "resources", ("total_bytes",)).select("id", "enabled", "has_issues", "total_bytes_text")


@_query("""WITH t AS (SELECT o_custkey AS customer, o_orderkey AS id, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS of FROM orders)
SELECT customer, id, CAST(place AS INTEGER) AS place, of FROM t WHERE place <= 3""")
def report_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of every section of a report, and how many it has; customers stand for sections."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("id"), "o_totalprice")
    return reports.first_rows(rows, ["customer"], [F.desc("o_totalprice"), F.asc("id")], 3).select("customer", "id", "place", "of")


@_query(r"""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), d AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
r AS (SELECT 1 AS section, row_number() OVER (ORDER BY n DESC, source NULLS FIRST) - 1 AS no, '<tr><td>' || coalesce(source, '') || '</td><td>' || n || '</td><td>' || format('{:.1f}', n / 2.0::DOUBLE) || '</td></tr>' AS line FROM c),
s AS (SELECT 2 AS section, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS no, '<tr><td>' || coalesce(lang, '') || '</td><td>' || n || '</td><td>&lt;&amp;&gt;</td></tr>' AS line FROM d),
a AS (SELECT * FROM r WHERE no < 5 UNION ALL SELECT 1, 5, '</table><p>There are more rows.</p>' FROM c HAVING count(*) > 5 UNION ALL SELECT 1, 6, '</table>' FROM c HAVING count(*) <= 5
UNION ALL SELECT * FROM s WHERE no < 5 UNION ALL SELECT 2, 5, '</table><p>There are more rows.</p>' FROM d HAVING count(*) > 5 UNION ALL SELECT 2, 6, '</table>' FROM d HAVING count(*) <= 5
UNION ALL SELECT 1, -1, '<h2>sources</h2><table><tr><th>source</th><th>n</th><th>half</th></tr>' UNION ALL SELECT 2, -1, '<h2>languages</h2><table><tr><th>lang</th><th>n</th><th>mark</th></tr>')
SELECT section, CAST(no AS INTEGER) AS no, regexp_replace(line, '\.0</td>', '</td>') AS line FROM a""")
def report_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a report's HTML page between head and end: two sections, five rows of each shown."""
    docs = _table(spark, sf_dir, "documents")
    sources = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("half", F.col("n") / 2).orderBy(F.desc("n"), F.asc_nulls_first("source"))
    languages = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("mark", F.lit("<&>")).orderBy(F.asc_nulls_first("lang"))
    return sinks.html_lines("A report", {"sources": sources, "languages": languages}, 5).filter(F.col("section").between(1, 2))
