"""Queries over furnished pages and built inputs, each with its oracle; importing the module adds them to the slate.

Inputs are built by arithmetic on row numbers in SQL that both engines read (see :mod:`.furnished`), so every branch
of an operator is met and the oracle needs no HTML, JSON or headers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import classify, scores, technologies, urls, vitals
from ..functions import text as tx
from ..operators import advice, api, captures, evidence, links, measurements, reports, requests, selectors, site, statistics, technical
from ..sources import archives, lighthouse, lists, site_files, sitemaps
from ..sources.shared import scratch_path, written
from ..thresholds import Thresholds
from .furnished import FACTS, OG, TWITTER, furnished
from .slate import _PATH, _query, _r, _sql_r, _table

_F = f"f AS ({FACTS})"
_LIST = "list_filter([{}], lambda x: x IS NOT NULL)"


def _joined(*items: str) -> str:
    return f"array_to_string({_LIST.format(', '.join(items))}, ',')"


def _text(column: str):
    return F.array_join(column, ",").alias(column)


def _built(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    """Rows that ``sql`` makes of a table, which it names in braces."""
    return spark.sql(sql, **{table: _table(spark, sf_dir, table)})


# -- what the extractor finds --------------------------------------------------------------------------------------------


@_query(f"""WITH {_F} SELECT url, title, description, 'a,k' || page_id % 3 AS keywords, canonical, viewport, lang, charset, CAST(n_h2 AS BIGINT) AS h2,
contains(lower(robots), 'noindex') AS noindex, contains(lower(robots), 'nofollow') AS nofollow, contains(lower(robots), 'noarchive') AS noarchive FROM f""")
def furnished_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, description, keywords, canonical link, viewport, language, charset and robots directives."""
    none = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    flag = lambda k: F.coalesce(F.try_element_at("robots_directives", F.lit(k)), F.lit(False)).alias(k)
    return furnished(spark, sf_dir).select("url", none("title"), none("description"), _text("keywords"), F.coalesce("canonical_url", F.lit("")).alias("canonical"), none("viewport"), none("lang"), none("charset"), F.size("h2_tags").cast("long").alias("h2"), flag("noindex"), flag("nofollow"), flag("noarchive"))


_IMAGES = """i AS (SELECT *, range(n_images) AS k FROM f)"""


@_query(f"""WITH {_F}, {_IMAGES} SELECT url, n_images AS total_images, len(list_filter(k, lambda i: i % 3 = 0)) AS images_without_alt, len(list_filter(k, lambda i: i % 4 = 3)) AS lazy_images,
len(list_filter(k, lambda i: i % 4 <> 3)) AS eager_images, len(list_filter(k, lambda i: i >= 3 AND i % 4 <> 3)) AS lazy_opportunities, len(list_filter(k, lambda i: i % 2 = 1)) AS cls_risks,
len(list_filter(k, lambda i: i < 5 AND i % 2 = 1)) + least(3, n_h1) AS lcp_candidates, 1 + CASE WHEN n_scripts > 3 THEN 2 WHEN n_scripts > 0 THEN 1 ELSE 0 END AS render_blocking,
CASE WHEN n_scripts > 3 THEN 2 WHEN n_scripts > 0 THEN 1 ELSE 0 END AS blocking_scripts FROM i""")
def furnished_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of images, of what shifts or blocks rendering, and of candidates for the largest element."""
    return furnished(spark, sf_dir).select("url", "total_images", "images_without_alt", "lazy_images", "eager_images", "lazy_opportunities", "cls_risks", "lcp_candidates", "render_blocking", "blocking_scripts")


@_query(f"""WITH {_F}, {_IMAGES}, x AS (SELECT url, page_id, unnest(k) AS i FROM i)
SELECT url, CAST(i AS INTEGER) AS pos, CASE (page_id + i) % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' WHEN 3 THEN 'svg' ELSE 'unknown' END AS format, i % 3 <> 0 AS has_alt, i % 2 = 0 AS has_dimensions FROM x""")
def furnished_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.image_rows(furnished(spark, sf_dir)).select("url", "pos", "format", "has_alt", "has_dimensions")


@_query(f"""WITH {_F}, {_IMAGES}, x AS (SELECT page_id, unnest(k) AS i FROM i),
a AS (SELECT count(*) AS images, count(*) FILTER (WHERE i % 3 <> 0) AS with_alt, count(*) FILTER (WHERE i % 2 <> 0) AS without_dimensions, count(*) FILTER (WHERE (page_id + i) % 5 = 2) AS modern, count(*) FILTER (WHERE (page_id + i) % 5 IN (0, 1)) AS convertible FROM x),
b AS (SELECT CAST(sum(len(list_filter(k, lambda i: i % 4 = 3))) AS BIGINT) AS lazy, CAST(sum(len(list_filter(k, lambda i: i % 4 <> 3))) AS BIGINT) AS eager, CAST(sum(greatest(0, len(list_filter(k, lambda i: i % 4 <> 3)) - 3)) AS BIGINT) AS should_be_lazy FROM i)
SELECT images, with_alt, without_dimensions, modern, convertible, lazy, eager, should_be_lazy, {_sql_r('with_alt * 100.0::DOUBLE / images')} AS alt_share, {_sql_r('lazy * 100.0::DOUBLE / (lazy + eager)')} AS lazy_share,
array_to_string(list_filter([CASE WHEN modern * 100.0 / images < 50 THEN 'modern_formats' END, CASE WHEN without_dimensions > 0 THEN 'dimensions' END, CASE WHEN should_be_lazy > 0 THEN 'lazy_loading' END, CASE WHEN with_alt * 100.0 / images < 90 THEN 'alt_text' END], lambda x: x IS NOT NULL), ',') AS rules FROM a, b""")
def furnished_image_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image coverage of the site and the rules that hold for it."""
    found = site.image_summary(furnished(spark, sf_dir))
    return found.select("images", "with_alt", "without_dimensions", "modern", "convertible", "lazy", "eager", "should_be_lazy", _r("alt_share").alias("alt_share"), _r("lazy_share").alias("lazy_share"), F.array_join(advice.image_rules(), ",").alias("rules"))


@_query(f"WITH {_F} SELECT url, n_buttons AS buttons_without_aria, n_anchors AS links_without_context, n_inputs AS inputs_without_labels FROM f")
def furnished_accessibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furnished(spark, sf_dir).select("url", "buttons_without_aria", "links_without_context", "inputs_without_labels")


# -- issues ----------------------------------------------------------------------------------------------------------------

#: Page text has the text of scripts: one word of each kind of structured data that is a script.
_WORDS = "(len(list_filter(string_split(title, ' '), lambda x: x <> '')) + n_h1 + n_h2 + n_words + CASE WHEN schema_kind IN (1, 2, 3, 4, 7) THEN 1 ELSE 0 END)"
_ALT = "len(list_filter(range(n_images), lambda i: i % 3 = 0))"
_ISSUES = f"""t AS (SELECT title, count(*) AS n FROM f WHERE title <> '' GROUP BY title HAVING count(*) > 1),
g AS (SELECT *, {_WORDS} AS words, {_ALT} AS no_alt FROM f),
i AS (SELECT url, unnest(list_filter([
  CASE WHEN title = '' THEN 'missing_title:critical' END, CASE WHEN title <> '' AND length(title) < 30 THEN 'short_title:warning' END, CASE WHEN length(title) > 60 THEN 'long_title:warning' END,
  CASE WHEN description = '' THEN 'missing_description:critical' END, CASE WHEN description <> '' AND length(description) < 120 THEN 'short_description:warning' END, CASE WHEN length(description) > 160 THEN 'long_description:warning' END,
  CASE WHEN n_h1 = 0 THEN 'missing_h1:critical' END, CASE WHEN n_h1 > 1 THEN 'multiple_h1:warning' END, CASE WHEN no_alt >= 5 THEN 'images_without_alt:critical' WHEN no_alt > 0 THEN 'images_without_alt:warning' END,
  CASE WHEN load_time > 5 THEN 'slow_page:critical' WHEN load_time > 3 THEN 'slow_page:warning' END, CASE WHEN words <= 100 THEN 'thin_content:critical' WHEN words < 300 THEN 'thin_content:warning' END,
  CASE WHEN canonical = '' THEN 'missing_canonical:warning' END], lambda x: x IS NOT NULL)) AS x FROM g
  UNION ALL SELECT url, CASE WHEN n = 2 THEN 'duplicate_title:warning' ELSE 'duplicate_title:critical' END FROM f JOIN t USING (title))"""


@_query(f"WITH {_F}, {_ISSUES} SELECT split_part(x, ':', 1) AS issue_type, split_part(x, ':', 2) AS severity, count(*) AS pages FROM i GROUP BY ALL")
def furnished_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every technical check, at both severities."""
    pages = furnished(spark, sf_dir)
    return technical.issue_rows(pages).groupBy("issue_type", "severity").agg(F.count(F.lit(1)).alias("pages"))


_FLAGS = _joined(
    "CASE WHEN title = '' THEN 'title' END", "CASE WHEN description = '' THEN 'desc' END", "CASE WHEN n_h1 = 0 THEN 'h1' END", "CASE WHEN canonical = '' THEN 'canonical' END", f"CASE WHEN {_WORDS} < 300 THEN 'thin' END",
    "CASE WHEN load_time > 3 THEN 'slow' END", "CASE WHEN performance < 50 THEN 'perf' END", f"CASE WHEN {_ALT} > 0 THEN 'alt' END",
    "CASE WHEN url NOT LIKE 'https://%' OR 1 + CAST(page_id % 2 = 0 AS INT) + CAST(page_id % 3 = 0 AS INT) + CAST(page_id % 5 = 0 AS INT) + CAST(page_id % 7 = 0 AS INT) < 3 THEN 'security' END",
    "CASE WHEN n_errors > 0 THEN 'errors' END", "CASE WHEN hops > 0 THEN 'redirect' END",
)


@_query(f"WITH {_F} SELECT url, {_FLAGS} AS flags, CAST({_ALT} + n_buttons + n_anchors + n_inputs AS BIGINT) AS accessibility FROM f")
def furnished_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eleven flags of the page matrix."""
    return technical.page_matrix(furnished(spark, sf_dir)).select("url", _text("flags"), F.col("accessibility").cast("long").alias("accessibility"))


@_query(f"WITH {_F} SELECT url, " + _joined("CASE WHEN title = '' THEN 'no title' END", "CASE WHEN description = '' THEN 'no description' END", "CASE WHEN n_h1 = 0 THEN 'no h1' END", f"CASE WHEN {_WORDS} < 300 THEN 'thin' END") + " AS status FROM f")
def furnished_status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furnished(spark, sf_dir).select("url", F.array_join(reports.status_flags(), ",").alias("status"))


@_query(f"""WITH {_F}, {_ISSUES}, s AS (SELECT split_part(x, ':', 1) AS k, url FROM i)
SELECT (SELECT count(*) FROM f) AS total_pages, count(DISTINCT url) AS pages_with_issues, count(*) FILTER (WHERE k <> 'duplicate_title') + (SELECT count(*) FROM t) AS technical_issues, count(*) FILTER (WHERE k = 'missing_title') AS missing_titles,
(SELECT count(*) FROM t) AS duplicate_titles, count(*) FILTER (WHERE k = 'slow_page') AS slow_pages, count(*) FILTER (WHERE k = 'images_without_alt') AS images_without_alt, (SELECT {_sql_r('avg(load_time)')} FROM f) AS avg_load_time FROM s""")
def furnished_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics row of a crawl."""
    pages = furnished(spark, sf_dir).drop("content_text")
    found = archives.snapshot_row(pages, technical.issue_rows(pages), "example.com", "2026-01-01")
    return found.select("total_pages", "pages_with_issues", "technical_issues", "missing_titles", "duplicate_titles", "slow_pages", "images_without_alt", _r("avg_load_time").alias("avg_load_time"))


# -- social, headers, mobile, languages --------------------------------------------------------------------------------------

_LISTED = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + "]"
_SOCIAL = f"""s AS (SELECT *, least(100, least(n_og, 5) * 15 + greatest(n_og - 5, 0) * 5 + CASE WHEN n_og >= 3 THEN 5 ELSE 0 END) AS og_score,
greatest(0, least(100, least(n_twitter, 3) * 25 + greatest(n_twitter - 3, 0) * 10 - CASE WHEN n_twitter > 0 AND card = 'banner' THEN 10 ELSE 0 END)) AS twitter_score,
({_LISTED(OG)})[n_og + 1 : 5] AS og_missing, ({_LISTED(TWITTER)})[n_twitter + 1 : 3] AS twitter_missing FROM f)"""


@_query(f"WITH {_F}, {_SOCIAL} SELECT url, n_og > 0 AS has_og, CAST(og_score AS INTEGER) AS og_score, array_to_string(og_missing, ',') AS og_missing, n_twitter > 0 AS has_twitter, CAST(twitter_score AS INTEGER) AS twitter_score, array_to_string(twitter_missing, ',') AS twitter_missing FROM s")
def furnished_social(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.social_rows(furnished(spark, sf_dir)).select("url", "has_og", "og_score", _text("og_missing"), "has_twitter", "twitter_score", _text("twitter_missing"))


@_query(f"""WITH {_F}, {_SOCIAL} SELECT count(*) AS pages, {_sql_r('count(*) FILTER (WHERE n_og > 0) * 100.0::DOUBLE / count(*)')} AS og_coverage, {_sql_r('count(*) FILTER (WHERE n_twitter > 0) * 100.0::DOUBLE / count(*)')} AS twitter_coverage,
{_sql_r('avg(og_score) FILTER (WHERE n_og > 0)')} AS og_score, {_sql_r('avg(twitter_score) FILTER (WHERE n_twitter > 0)')} AS twitter_score FROM s""")
def furnished_social_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = site.social_summary(site.social_rows(furnished(spark, sf_dir)))
    return found.select("pages", *[_r(c).alias(c) for c in ("og_coverage", "twitter_coverage", "og_score", "twitter_score")])


@_query(f"WITH {_F}, {_SOCIAL}, m AS (SELECT unnest(list_concat(og_missing, twitter_missing)) AS property FROM s) SELECT property, count(*) AS pages FROM m GROUP BY property ORDER BY pages DESC, property LIMIT 10")
def furnished_missing_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.missing_properties(site.social_rows(furnished(spark, sf_dir)))


@_query(f"""WITH {_F}, {_SOCIAL}, r AS (SELECT url, page_id, CAST(og_score + twitter_score AS INTEGER) AS score FROM s)
SELECT * FROM (SELECT 'best' AS list, url, score FROM r WHERE score > 0 ORDER BY score DESC, page_id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'worst', url, score FROM r ORDER BY score, page_id LIMIT 10)""")
def furnished_social_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best and ten worst pages by social scores."""
    best, worst = reports.social_extremes(site.social_rows(furnished(spark, sf_dir)))
    named = lambda rows, name: rows.select(F.lit(name).alias("list"), "url", "score")
    return named(best, "best").unionByName(named(worst, "worst"))


_SECURITY = "CASE WHEN url LIKE 'https://%' THEN 40 ELSE 0 END + CASE WHEN page_id % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN page_id % 3 = 0 THEN 20 ELSE 0 END + CASE WHEN page_id % 5 = 0 THEN 10 ELSE 0 END + CASE WHEN page_id % 7 = 0 THEN 10 ELSE 0 END"
_MOBILE = _LIST.format("CASE page_id % 5 WHEN 0 THEN 'missing_viewport' WHEN 2 THEN 'fixed_width' WHEN 3 THEN 'not_device_width' END, CASE WHEN n_images > 10 THEN 'no_srcset' END")
_MOBILE_SCORE = f"100 - list_sum(list_concat([0], list_transform({_MOBILE}, lambda x: CASE WHEN x = 'missing_viewport' THEN 40 ELSE 20 END)))"


@_query(f"WITH {_F} SELECT url, CAST({_SECURITY} AS INTEGER) AS security, array_to_string({_MOBILE}, ',') AS mobile_issues, CAST({_MOBILE_SCORE} AS INTEGER) AS mobile FROM f")
def furnished_security_mobile(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = furnished(spark, sf_dir)
    issues = scores.mobile_issues(F.col("viewport"), F.col("total_images"), F.col("images"))
    return pages.select("url", scores.security_score(F.col("url"), F.col("headers")).alias("security"), F.array_join(issues, ",").alias("mobile_issues"), scores.mobile_score(issues).alias("mobile"))


@_query(f"""WITH {_F} SELECT header, pages, CASE WHEN pages = 0 THEN 'none' WHEN pages = (SELECT count(*) FROM f) THEN 'complete' ELSE 'partial' END AS state FROM (
SELECT 'strict-transport-security' AS header, count(*) FILTER (WHERE page_id % 2 = 0) AS pages FROM f UNION ALL SELECT 'x-content-type-options', count(*) FILTER (WHERE page_id % 5 = 0) FROM f
UNION ALL SELECT 'x-frame-options', count(*) FILTER (WHERE page_id % 7 = 0) FROM f UNION ALL SELECT 'content-security-policy', count(*) FILTER (WHERE page_id % 3 = 0) FROM f)""")
def furnished_header_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.header_coverage(site.security_rows(furnished(spark, sf_dir)))


@_query(f"""WITH {_F} SELECT url, CASE alternates WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS hreflang, {_joined("CASE WHEN lang = '' THEN 'missing_lang' END", "CASE WHEN alternates = 3 THEN 'no_self_reference' END",
"CASE alternates WHEN 2 THEN 'invalid_hreflang:xx' WHEN 3 THEN 'invalid_hreflang:x-default' END", "CASE WHEN charset = '' THEN 'missing_charset' WHEN lower(charset) <> 'utf-8' THEN 'not_utf8' END")} AS issues FROM f""")
def furnished_international(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.international_rows(furnished(spark, sf_dir)).select("url", "hreflang", _text("issues"))


@_query(f"WITH {_F} SELECT {_sql_r('avg(' + _SECURITY + ')')} AS security, {_sql_r('avg(' + _MOBILE_SCORE + ')')} AS mobile, count(*) FILTER (WHERE url LIKE 'https://%') AS https FROM f")
def furnished_advanced_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """https pages and the mean security and mobile scores of the site."""
    pages = furnished(spark, sf_dir)
    found = site.advanced_summary(pages, spark.createDataFrame([(1.0,)], "score double"))
    return found.select(_r("security").alias("security"), _r("mobile").alias("mobile"), "https")


# -- structured data ---------------------------------------------------------------------------------------------------------

_KINDS = """k AS (SELECT *, CASE WHEN schema_kind IN (1, 2, 3, 7) THEN 1 ELSE 0 END AS blocks, CASE WHEN schema_kind = 5 THEN 1 ELSE 0 END AS items,
CASE schema_kind WHEN 1 THEN 'Product' WHEN 2 THEN 'Organization,Article,Thing' WHEN 3 THEN 'FAQPage,Question' WHEN 5 THEN 'Recipe' WHEN 6 THEN 'Event,Place' WHEN 7 THEN 'BreadcrumbList' ELSE '' END AS types,
CASE schema_kind WHEN 1 THEN 'Product.image' WHEN 3 THEN 'FAQPage.mainEntity[0].acceptedAnswer' WHEN 7 THEN 'BreadcrumbList.itemListElement' ELSE '' END AS errors,
CASE schema_kind WHEN 1 THEN 'Product.offers,Product.review' ELSE '' END AS warnings, CASE schema_kind WHEN 4 THEN 1 ELSE 0 END AS broken,
array_to_string(list_filter([CASE WHEN section = 0 AND schema_kind <> 1 THEN 'Product' END, CASE WHEN section = 2 AND schema_kind <> 2 THEN 'Article' END, CASE WHEN section = 1 THEN 'VideoObject' END,
  CASE WHEN contains(right(url, 2), '/') AND schema_kind <> 2 THEN 'Organization' END], lambda x: x IS NOT NULL), ',') AS missing FROM f),
n AS (SELECT *, CASE WHEN types = '' THEN 0 ELSE len(string_split(types, ',')) END AS n_types, CASE WHEN errors = '' THEN 0 ELSE 1 END AS n_errs, CASE WHEN missing = '' THEN 0 ELSE len(string_split(missing, ',')) END AS n_missing,
CASE WHEN schema_kind IN (1, 2, 3, 5, 6) THEN 1 ELSE 0 END AS eligible FROM k),
z AS (SELECT *, least(100, CASE WHEN blocks + items > 0 THEN 30 ELSE 0 END + CASE WHEN blocks > 0 THEN 10 ELSE 0 END + CASE WHEN n_types >= 2 THEN 10 WHEN n_types = 1 THEN 5 ELSE 0 END + CASE n_errs WHEN 0 THEN 20 ELSE 10 END
+ eligible * 10 + CASE WHEN n_missing = 0 THEN 15 WHEN n_missing <= 2 THEN 10 ELSE 5 END) AS score FROM n)"""


@_query(f"WITH {_F}, {_KINDS} SELECT url, blocks AS json_ld, broken, items AS microdata, CAST(CASE WHEN schema_kind = 6 THEN 1 ELSE 0 END AS BIGINT) AS rdfa, types, errors, warnings FROM n".replace("blocks AS json_ld, broken, items AS microdata", "CAST(blocks AS BIGINT) AS json_ld, CAST(broken AS BIGINT) AS broken, CAST(items AS BIGINT) AS microdata"))
def furnished_structured_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-LD, microdata and RDFa of every page, with what its validator finds."""
    p = furnished(spark, sf_dir)
    return p.select("url", F.size("json_ld").cast("long").alias("json_ld"), F.col("json_ld_errors").alias("broken"), F.col("microdata_count").alias("microdata"), F.col("rdfa_count").alias("rdfa"), F.array_join("schema_types", ",").alias("types"), F.array_join("schema_errors", ",").alias("errors"), F.array_join("schema_warnings", ",").alias("warnings"))


@_query(f"WITH {_F}, {_KINDS} SELECT url, missing, CAST(score AS INTEGER) AS score FROM z")
def furnished_structured_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema types that a page's content asks for but lacks, and its score."""
    return site.structured_data_rows(furnished(spark, sf_dir)).select("url", _text("missing"), "score")


@_query(f"""WITH {_F}, {_KINDS} SELECT count(*) AS pages, count(*) FILTER (WHERE n_types + blocks + items > 0) AS with_schema, CAST(sum(blocks) AS BIGINT) AS json_ld, CAST(sum(items) AS BIGINT) AS microdata, CAST(sum(n_errs) AS BIGINT) AS errors, {_sql_r('avg(score)')} AS score,
CASE WHEN avg(score) >= 80 THEN 'excellent' WHEN avg(score) >= 60 THEN 'good' WHEN avg(score) >= 40 THEN 'needs-improvement' ELSE 'poor' END AS status FROM z""")
def furnished_structured_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = site.structured_data_summary(site.structured_data_rows(furnished(spark, sf_dir)))
    return found.select("pages", "with_schema", F.col("json_ld").cast("long").alias("json_ld"), F.col("microdata").cast("long").alias("microdata"), F.col("errors").cast("long").alias("errors"), _r("score").alias("score"), "status")


@_query(f"WITH {_F}, {_KINDS}, r AS (SELECT url, unnest([CASE schema_kind WHEN 1 THEN 'product' WHEN 2 THEN 'article' WHEN 3 THEN 'faq' WHEN 5 THEN 'recipe' WHEN 6 THEN 'event' END]) AS result FROM n) SELECT result, count(*) AS pages FROM r WHERE result IS NOT NULL GROUP BY result")
def furnished_rich_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that each rich result is open to."""
    rows = furnished(spark, sf_dir).select(F.explode(scores.rich_results(F.col("schema_types"))).alias("result", "open")).filter("open")
    return rows.groupBy("result").agg(F.count(F.lit(1)).alias("pages"))


@_query(f"""WITH {_F}, x AS (SELECT url, unnest(list_filter([CASE section WHEN 0 THEN 'product' WHEN 1 THEN 'video' WHEN 2 THEN 'article' END, CASE WHEN contains(right(url, 2), '/') THEN 'homepage' END], lambda x: x IS NOT NULL)) AS kind FROM f) SELECT kind, count(*) AS pages FROM x GROUP BY kind""")
def furnished_page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furnished(spark, sf_dir).select(F.explode("page_types").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("pages"))


# -- measurements ------------------------------------------------------------------------------------------------------------

_VITALS = f"""m AS (SELECT url, CASE WHEN load_time + 0.5 <= 2.5 THEN 'good' WHEN load_time + 0.5 <= 4 THEN 'needs-improvement' WHEN load_time IS NOT NULL THEN 'poor'
  WHEN lcp = 0 THEN 'good' WHEN lcp <= 2 THEN 'needs-improvement' ELSE 'poor' END AS lcp, CASE WHEN b = 0 THEN 'good' WHEN b <= 3 THEN 'needs-improvement' ELSE 'poor' END AS inp, CASE WHEN c = 0 THEN 'good' WHEN c <= 5 THEN 'needs-improvement' ELSE 'poor' END AS cls FROM (
  SELECT url, load_time, len(list_filter(range(n_images), lambda i: i < 5 AND i % 2 = 1)) + least(3, n_h1) AS lcp, CASE WHEN n_scripts > 3 THEN 2 WHEN n_scripts > 0 THEN 1 ELSE 0 END AS b, len(list_filter(range(n_images), lambda i: i % 2 = 1)) AS c FROM f))"""


@_query(f"WITH {_F}, {_VITALS} SELECT url, lcp, inp, cls, CASE WHEN 'poor' IN (lcp, inp, cls) THEN 'poor' WHEN 'needs-improvement' IN (lcp, inp, cls) THEN 'needs-improvement' ELSE 'good' END AS overall FROM m")
def furnished_vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.vitals_rows(furnished(spark, sf_dir)).select("url", "lcp", "inp", "cls", "overall")


@_query(f"WITH {_F} SELECT url, CAST(performance AS DOUBLE) AS lighthouse_performance FROM f WHERE performance < 50")
def furnished_poor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.poor_pages(furnished(spark, sf_dir))


_REPORT = """
SELECT page_id, '{"requestedUrl":"' || url || '","finalUrl":"' || url || '","categories":{"performance":{"score":' || (page_id % 101) / 100.0D || '},"accessibility":{"score":' || (page_id % 50) / 50.0D || '},"seo":{"score":1}'
|| CASE WHEN page_id % 2 = 0 THEN ',"pwa":{"score":0.5}' ELSE '' END || '},"audits":{"largest-contentful-paint":{"numericValue":' || page_id % 6000 || '},"total-blocking-time":{"numericValue":' || page_id % 900 || '},'
|| '"unused-javascript":{"title":"Unused","score":0.1,"details":{"overallSavingsMs":' || page_id % 700 || ',"overallSavingsBytes":' || page_id % 1000 || ',"items":[{},{}]}},"unminified-css":{"title":"Css","score":1},"dom-size":{"numericValue":' || page_id % 3
|| '},"resource-summary":{"details":{"items":[{"resourceType":"script","requestCount":' || page_id % 4 || ',"transferSize":10},{"resourceType":"font","requestCount":1,"transferSize":5}]}},"network-requests":{"details":{"items":[{},{},{}]}}}}' AS report FROM {pages}"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = spark.sql(_REPORT.replace("{", "{{").replace("}", "}}").replace("{{pages}}", "{pages}"), pages=_table(spark, sf_dir, "pages"))
    broken = _table(spark, sf_dir, "pages").filter("page_id % 10 = 0").select((-F.col("page_id") - 1).alias("page_id"), F.lit('{"categories": ').alias("report"))
    return lighthouse.parse(built.unionByName(broken).withColumnRenamed("report", "json"), "json")


@_query(f"""SELECT page_id, url AS requested_url, CAST(page_id % 101 AS DOUBLE) AS performance, CAST(page_id % 50 * 2 AS DOUBLE) AS accessibility, CAST(100 AS DOUBLE) AS seo, CASE WHEN page_id % 2 = 0 THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END AS pwa,
CAST(page_id % 6000 AS DOUBLE) AS lcp, CAST(page_id % 900 AS DOUBLE) AS tbt FROM pages""")
def lighthouse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and metrics of result files, broken ones left out."""
    found = lighthouse.scores(_reports(spark, sf_dir))
    return found.select("page_id", "requested_url", _r("lighthouse_performance").alias("performance"), _r("lighthouse_accessibility").alias("accessibility"), _r("lighthouse_seo").alias("seo"), _r("lighthouse_pwa").alias("pwa"), F.col("lighthouse_lcp").alias("lcp"), F.col("lighthouse_tbt").alias("tbt"))


@_query("SELECT page_id, 'unused-javascript' AS id, 'Unused' AS title, CAST(page_id % 700 AS DOUBLE) AS savings_ms, page_id % 1000 AS savings_bytes, 2 AS items FROM pages")
def lighthouse_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lighthouse.opportunities(_reports(spark, sf_dir))


@_query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE CAST(page_id % 3 AS DOUBLE) END AS dom_size, 3 AS requests FROM pages")
def lighthouse_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lighthouse.diagnostics(_reports(spark, sf_dir)).select("page_id", "dom_size", "requests")


@_query(f"""SELECT count(*) AS audited, {_sql_r('avg(page_id % 101)')} AS performance, {_sql_r('avg(page_id % 50 * 2)')} AS accessibility, {_sql_r('avg(CASE WHEN page_id % 6000 = 0 THEN NULL ELSE page_id % 6000 END)')} AS lcp,
CASE WHEN avg(page_id % 101) >= 90 THEN 'good' WHEN avg(page_id % 101) >= 50 THEN 'needs-improvement' ELSE 'poor' END AS performance_status FROM pages""")
def lighthouse_site_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lighthouse.scores(_reports(spark, sf_dir))
    summary = statistics.lighthouse_summary(found.withColumn("lighthouse_best_practices", F.coalesce("lighthouse_best_practices", F.lit(0.0))))
    return summary.select("audited", _r("performance").alias("performance"), _r("accessibility").alias("accessibility"), _r("lcp").alias("lcp"), "performance_status")


@_query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 100 <= 2500 THEN 'good' WHEN l_quantity * 100 <= 4000 THEN 'needs-improvement' ELSE 'poor' END AS lcp,
CASE WHEN l_quantity * 8 <= 100 THEN 'good' WHEN l_quantity * 8 <= 300 THEN 'needs-improvement' ELSE 'poor' END AS fid, CASE WHEN l_linenumber = 1 OR l_discount * 4 <= 0.1 THEN 'good' WHEN l_discount * 4 <= 0.25 THEN 'needs-improvement' ELSE 'poor' END AS cls,
CASE WHEN l_quantity * 40 <= 800 THEN 'good' WHEN l_quantity * 40 <= 1800 THEN 'needs-improvement' ELSE 'poor' END AS ttfb FROM lineitem""")
def measured_vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of browser measurements; quantities and discounts of lineitem stand for them."""
    cls = F.when(F.col("l_linenumber") != 1, F.col("l_discount") * 4)
    found = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", vitals.measured_status(F.col("l_quantity") * 100, F.col("l_quantity") * 8, cls).alias("s"), vitals.ttfb_status(F.col("l_quantity") * 40).alias("ttfb"))
    return found.select("l_orderkey", "l_linenumber", "s.lcp", "s.fid", "s.cls", "ttfb")


@_query(f"SELECT l_orderkey, {_sql_r('sum(greatest(0, l_quantity * 4 - 50))', 2)} AS blocking FROM lineitem GROUP BY l_orderkey")
def blocking_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total blocking time of the long tasks of a page; quantities of an order stand for them."""
    tasks = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity") * 4).alias("t"))
    return tasks.select("l_orderkey", _r(vitals.total_blocking_time(F.col("t")), 2).alias("blocking"))


@_query("SELECT DISTINCT o_orderpriority, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'good' WHEN '2' THEN 'needs-improvement' WHEN '3' THEN 'poor' END AS status FROM orders")
def field_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of field data; priorities 1 to 3 stand for FAST, average and SLOW, others for unknown words."""
    words = F.create_map(*[F.lit(x) for x in ("1", "FAST", "2", "average", "3", "SLOW")])
    return _table(spark, sf_dir, "orders").select("o_orderpriority", vitals.field_category(F.coalesce(F.try_element_at(words, F.substring("o_orderpriority", 1, 1)), F.lit("?"))).alias("status")).distinct()


@_query("""SELECT p.doc_id, CASE WHEN l.doc_id IS NULL THEN -1 ELSE l.quality END AS quality, CASE WHEN l.doc_id IS NULL THEN -2 ELSE l.toxic END AS toxic FROM documents p LEFT JOIN labels l USING (doc_id)""")
def psi_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements overwrite those of a page wherever there are any; labels stand for them."""
    entries = _table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality"), F.lit(-2).alias("toxic"))
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    return measurements.overwrite(entries, labels, "doc_id", ("quality", "toxic"))


# -- technologies, firewalls, frameworks, forms ------------------------------------------------------------------------------

#: Marks of a page by its number, and the technology that each gives away.
_MARKS = ("hotjar", "tailwind", "woocommerce", "wp-content", "matomo", "klarna", "svelte", "drupal", "olark", "swiper")
_NAMES = ("Hotjar", "Tailwind CSS", "WooCommerce", "WordPress", "Matomo", "Klarna", "Svelte", "Drupal", "Olark", "Swiper")
_TECH = f"""w AS (SELECT page_id, url, list_sort(list_distinct(list_filter([({_LISTED(_NAMES)})[page_id % 10 + 1], ({_LISTED(_NAMES)})[page_id // 10 % 10 + 1],
CASE page_id % 3 WHEN 0 THEN 'Nginx' WHEN 1 THEN 'Apache' END, CASE WHEN page_id % 4 = 0 THEN 'PHP' END, CASE WHEN page_id % 5 = 0 THEN 'Vercel' END], lambda x: x IS NOT NULL))) AS found FROM pages)"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array(*[F.lit(m) for m in _MARKS])
    n = F.col("page_id")
    at = lambda k: F.element_at(marks, (k % 10 + 1).cast("int"))
    html = F.concat(F.lit("<p>"), at(n), F.lit("</p><p>"), F.upper(F.when(at(F.floor(n / 10)) == "wp-content", "-").otherwise(at(F.floor(n / 10)))), F.when(at(F.floor(n / 10)) == "wp-content", "wp-content").otherwise(""), F.lit("</p>"))
    headers = F.expr("map_from_entries(array_compact(array(if(page_id % 3 = 0, struct('Server' as key, 'nginx/1.2' as value), if(page_id % 3 = 1, struct('SERVER' as key, 'Apache' as value), null)), if(page_id % 4 = 0, struct('X-Powered-By' as key, 'PHP/8' as value), null), if(page_id % 5 = 0, struct('X-Vercel-Id' as key, 'x' as value), null))))")
    return _table(spark, sf_dir, "pages").select("page_id", "url", F.col("page_id").alias("crawl_seq"), technologies.detect(html, headers).alias("technologies"))


@_query(f"WITH {_TECH} SELECT url, array_to_string(found, ',') AS technologies FROM w")
def marked_technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technologies by marks in markup and headers."""
    return _marked(spark, sf_dir).select("url", _text("technologies"))


@_query(f"""WITH {_TECH}, x AS (SELECT page_id, url, unnest(found) AS technology FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY technology ORDER BY page_id) AS n FROM x)
SELECT technology, count(*) AS pages, {_sql_r('count(*) * 100.0::DOUBLE / (SELECT count(*) FROM pages)')} AS share, string_agg(url, ' ' ORDER BY n) FILTER (WHERE n <= 10) AS examples FROM r GROUP BY technology ORDER BY pages DESC, min(page_id), technology LIMIT 20""")
def marked_technology_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent technologies with their share and first pages."""
    return site.technology_coverage(_marked(spark, sf_dir)).select("technology", "pages", _r("share").alias("share"), F.array_join("examples", " ").alias("examples"))


_CATEGORY = {"Hotjar": "Analytics", "Tailwind CSS": "CSS Frameworks", "WooCommerce": "Ecommerce", "WordPress": "CMS", "Matomo": "Analytics", "Klarna": "Payment", "Svelte": "JavaScript Frameworks", "Drupal": "CMS", "Olark": "Live Chat", "Swiper": "JavaScript Libraries", "Nginx": "Web Servers", "Apache": "Web Servers", "PHP": "Programming Languages", "Vercel": "Hosting Platforms"}
_CASES = "CASE technology " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CATEGORY.items()) + " ELSE 'Other' END"


@_query(f"WITH {_TECH}, x AS (SELECT unnest(found) AS technology FROM w) SELECT {_CASES} AS category, count(*) AS uses, count(DISTINCT technology) AS technologies FROM x GROUP BY category")
def marked_technology_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _marked(spark, sf_dir).select(F.explode("technologies").alias("technology"))
    return rows.groupBy(technologies.category(F.col("technology")).alias("category")).agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("technology").alias("technologies"))


@_query(f"""WITH {_TECH} SELECT url, CAST(len(found) AS INTEGER) AS technologies, list_filter(found, lambda x: x = 'WooCommerce')[1] AS ecommerce, list_filter(found, lambda x: x IN ('WordPress', 'Drupal'))[1] AS cms, list_filter(found, lambda x: x IN ('Nginx', 'Apache'))[1] AS server FROM w""")
def marked_technology_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("url", technologies.summary(F.col("technologies")).alias("s")).select("url", "s.*")


#: Stored responses: status, text, and what is to be seen in them.
_RESPONSES = (
    (200, "Just a moment...</title>", "challenge_page"),
    (403, "Access Denied</title> Reference #18", "akamai"),
    (200, "Please complete the security check to access. Ray ID: 1", "cloudflare"),
    (429, "Too Many Requests", "waf_block"),
    (503, "forbidden", "waf_block"),
    (404, "Access Denied</title>", None),
    (200, "welcome", None),
    (406, "Incapsula incident ID: 7", "imperva"),
    (403, "hello", None),
    (451, "press & hold", "perimeterx"),
    (200, "blocked by datadome", None),
)


@_query("SELECT page_id, CASE page_id % 11 " + " ".join(f"WHEN {i} THEN '{x[2]}'" for i, x in enumerate(_RESPONSES) if x[2]) + " END AS firewall FROM pages")
def firewalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firewalls and challenges in stored responses."""
    at = (F.col("page_id") % len(_RESPONSES) + 1).cast("int")
    status, body = F.element_at(F.array(*[F.lit(x[0]) for x in _RESPONSES]), at), F.element_at(F.array(*[F.lit(x[1]) for x in _RESPONSES]), at)
    return _table(spark, sf_dir, "pages").select("page_id", classify.firewall(status, body).alias("firewall"))


@_query(f"""WITH c AS (SELECT count(*) AS pages, count(*) FILTER (WHERE page_id % 5 < 2) AS challenged, count(*) FILTER (WHERE page_id % 5 = 1) AS blocking FROM pages)
SELECT pages, challenged, blocking, {_sql_r('challenged * 100.0::DOUBLE / pages')} AS rate, CASE WHEN challenged = 0 THEN 'good' WHEN challenged * 100.0 / pages > 50 THEN 'critical' WHEN challenged * 100.0 / pages > 20 THEN 'high' WHEN challenged * 100.0 / pages > 5 THEN 'medium' ELSE 'low' END AS level FROM c""")
def challenge_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _built(spark, sf_dir, "pages", "SELECT url, CASE page_id % 5 WHEN 0 THEN 'v2' WHEN 1 THEN 'v3' END AS challenge_version, page_id % 5 = 1 AS blocking FROM {pages}")
    return site.challenge_summary(rows).withColumn("rate", _r("rate"))


@_query("""SELECT url, 'challenge_' || coalesce(CASE page_id % 3 WHEN 0 THEN 'v2' WHEN 1 THEN 'v3' END, 'unknown') AS finding, CASE page_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity,
CASE WHEN page_id % 5 = 0 THEN 'resolve_manually' WHEN page_id % 3 = 1 THEN 'lower_request_rate' WHEN page_id % 3 = 0 THEN 'keep_session' END AS advice FROM pages""")
def challenge_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _built(spark, sf_dir, "pages", "SELECT url, CASE page_id % 3 WHEN 0 THEN 'v2' WHEN 1 THEN 'v3' END AS version, CASE page_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS impact, page_id % 5 = 0 AS blocking FROM {pages}")
    return evidence.challenge_evidence(rows)


#: Markup of frameworks, what it shows, and the confidence.
_FRAMEWORKS = (
    ('<div data-reactroot="">__NEXT_DATA__</div>', "react", 0.7),
    ('<div data-v-1a2b3c4d v-if="x">__NUXT__</div>', "vue", 0.9),
    ('<app ng-version="17" _nghost="x" ng-app></app>', "angular", 0.9),
    ('<p class="svelte-ab1">Svelte</p>', "svelte", 0.7),
    ("<p v-for>plain</p>", "unknown", 0.0),
    ("<p>react and react-dom _reactRootContainer</p>", "react", 0.5),
)


@_query("SELECT page_id, CASE page_id % 6 " + " ".join(f"WHEN {i} THEN '{x[1]}'" for i, x in enumerate(_FRAMEWORKS)) + " END AS framework, CASE page_id % 6 " + " ".join(f"WHEN {i} THEN {x[2]}::DOUBLE" for i, x in enumerate(_FRAMEWORKS)) + " END AS confidence FROM pages")
def frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    markup = F.element_at(F.array(*[F.lit(x[0]) for x in _FRAMEWORKS]), (F.col("page_id") % len(_FRAMEWORKS) + 1).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", classify.framework(markup).alias("f")).select("page_id", "f.framework", _r("f.confidence").alias("confidence"))


#: Form fields: name, kind, class.
_FIELDS = (
    ("firstName", "text", "first_name"), ("x", "email", "email"), ("phone_no", "text", "phone"), ("login", "text", "username"), ("y", "password", "password"), ("postcode", "text", "zip"), ("query", "text", "search"),
    ("street", "text", "address"), ("town", "text", "city"), ("province", "text", "state"), ("comment", "textarea", "message"), ("cvv", "text", "cc_cvv"), ("zzz", "text", "unknown"), ("t", "tel", "phone"),
)


@_query("SELECT page_id, CASE page_id % 14 " + " ".join(f"WHEN {i} THEN '{x[2]}'" for i, x in enumerate(_FIELDS)) + " END AS field FROM pages")
def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("page_id") % len(_FIELDS) + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in _FIELDS]), at)
    return _table(spark, sf_dir, "pages").select("page_id", classify.form_field(pick(0), F.lit(None).cast("string"), F.lit(""), F.lit(""), pick(1)).alias("field"))


#: Fields of a form and its type.
_FORMS = (
    (("username", "password"), "login"), (("username", "password", "email"), "signup"), (("email", "first_name"), "signup"), (("email", "message"), "contact"), (("address", "city", "state", "zip"), "address"),
    (("search",), "search"), (("cc_cvv", "username", "password"), "payment"), (("city",), "unknown"),
)


@_query("SELECT page_id, CASE page_id % 8 " + " ".join(f"WHEN {i} THEN '{x[1]}'" for i, x in enumerate(_FORMS)) + " END AS form FROM pages")
def form_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array(*[F.array(*[F.lit(y) for y in x[0]]) for x in _FORMS])
    return _table(spark, sf_dir, "pages").select("page_id", classify.form_type(F.element_at(listed, (F.col("page_id") % len(_FORMS) + 1).cast("int"))).alias("form"))


#: Attribute values and whether they look generated.
_VALUES = (("main-nav", False), ("sc-abc-def1", True), ("css-1a2b3", True), ("block__elem--x1", True), ("_abcdefgh1", True), ("item123456", True), ("42", True), ("header", False), ("a1b2c3d4-e5f6-x", True), ("x9y8z7w6v5u4t3s2r1q0p", True), ("", False))


@_query("SELECT page_id, CASE page_id % 11 " + " ".join(f"WHEN {i} THEN {str(x[1]).lower()}" for i, x in enumerate(_VALUES)) + " END AS generated FROM pages")
def generated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.element_at(F.array(*[F.lit(x[0]) for x in _VALUES]), (F.col("page_id") % len(_VALUES) + 1).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", classify.is_dynamic_value(value).alias("generated"))


# -- robots.txt, sitemaps, crawls ---------------------------------------------------------------------------------------------

_ROBOTS = """
SELECT 'https://h' || c_custkey AS domain, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'User-agent: *' || chr(10) || 'Disallow: /private' || chr(10) || '# note: x' || chr(10) || 'Sitemap: https://h/s' || c_custkey || '.xml'
WHEN 2 THEN 'Disallow: /' WHEN 3 THEN 'User-agent: A' || chr(10) || 'Disallow: /js' || chr(10) || 'Disallow:' || chr(10) || 'User-Agent: b' || chr(10) || 'Allow: /' WHEN 4 THEN 'User-agent: *' || chr(10) || 'Disallow:'
ELSE 'Sitemap: https://a/1' || chr(10) || 'SITEMAP: https://a/2' || chr(10) || 'User-agent: *' END AS content FROM {customer}
"""


@_query("""SELECT 'https://h' || c_custkey AS domain, c_custkey % 6 <> 0 AS has_robots, CASE c_custkey % 6 WHEN 1 THEN 'https://h/s' || c_custkey || '.xml' WHEN 5 THEN 'https://a/1,https://a/2' ELSE '' END AS sitemaps,
CASE c_custkey % 6 WHEN 2 THEN 'no_user_agent,blocks_all' WHEN 1 THEN 'blocks_all' WHEN 3 THEN 'blocks_all' ELSE '' END AS errors, CASE c_custkey % 6 WHEN 0 THEN 'not_fetched' WHEN 3 THEN 'blocks_assets' ELSE '' END AS warnings FROM customer""")
def robots_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = site_files.robots_analysis(_built(spark, sf_dir, "customer", _ROBOTS))
    return found.select("domain", "has_robots", _text("sitemaps"), _text("errors"), _text("warnings"))


@_query("""SELECT 'https://h' || c_custkey AS domain, agent, CAST(rules AS BIGINT) AS rules FROM customer, (VALUES (1, '*', 1), (2, '*', 1), (3, 'a', 2), (3, 'b', 0), (4, '*', 1), (5, '*', 0)) v(k, agent, rules) WHERE c_custkey % 6 = k""")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of every user agent of every robots.txt."""
    return site_files.rules_by_agent(_built(spark, sf_dir, "customer", _ROBOTS))


@_query("SELECT 'https://h' || c_custkey AS domain, c_custkey % 6 <> 3 AS home, c_custkey % 6 <> 1 AS private FROM customer")
def robots_fetching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each robots.txt lets the agent A fetch: a script and a private page."""
    rows = _built(spark, sf_dir, "customer", _ROBOTS)
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("page"), F.concat("domain", F.lit(p)).alias("url")) for n, p in (("home", "/js/x"), ("private", "/private/x"))]))
    requests = rows.select("domain", F.lit("A").alias("agent"), asked.alias("a")).select("domain", "agent", "a.*")
    decided = site_files.fetch_decisions(requests, rows)
    return decided.groupBy("domain").agg(*[F.bool_and(F.when(F.col("page") == n, F.col("allowed"))).alias(n) for n in ("home", "private")])


@_query("""WITH c AS (SELECT 'https://h' || c_custkey AS domain, c_custkey % 6 AS k, c_custkey % 90 AS broken, least(c_custkey % 14, 10) AS orphans FROM customer),
e AS (SELECT *, k <> 0 AS robots, k IN (1, 5) AS map, CASE k WHEN 2 THEN 2 WHEN 1 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS errs FROM c),
v AS (SELECT *, 100 - least(broken * 0.5, 30) - least(orphans * 2, 20) - CASE WHEN map THEN 0 ELSE 30 END - errs * 5 AS x FROM e), w AS (SELECT *, CAST(greatest(0, floor(x)) AS INTEGER) AS efficiency FROM v)
SELECT domain, robots AS has_robots, map AS has_sitemap, efficiency, CAST(least(100, CASE WHEN robots THEN 20 ELSE 0 END + CASE errs WHEN 0 THEN 15 WHEN 1 THEN 10 ELSE 0 END + CASE WHEN map THEN 25 ELSE 0 END + CASE WHEN map THEN 15 ELSE 10 END
+ CASE WHEN orphans = 0 THEN 10 WHEN orphans <= 5 THEN 5 ELSE 0 END + CASE WHEN efficiency >= 90 THEN 15 WHEN efficiency >= 70 THEN 10 WHEN efficiency >= 50 THEN 5 ELSE 0 END) AS INTEGER) AS score FROM w""")
def crawlability_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Efficiency and crawlability of every host."""
    counts = _built(spark, sf_dir, "customer", "SELECT 'https://h' || c_custkey AS domain, c_custkey % 90 AS broken, c_custkey % 14 AS orphans FROM {customer}")
    found = site_files.crawlability(site_files.robots_analysis(_built(spark, sf_dir, "customer", _ROBOTS)), counts)
    return found.select("domain", "has_robots", "has_sitemap", F.col("efficiency").cast("int").alias("efficiency"), F.col("score").cast("int").alias("score"))


@_query("SELECT DISTINCT 'https://s/' || p_partkey || '?a=1&b=2' AS url FROM part")
def sitemap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of a sitemap index over one sitemap a brand, some wrapped in HTML, some in CDATA."""
    part = _table(spark, sf_dir, "part")
    located = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<url><loc> https://s/"), "p_partkey", F.lit("?a=1&amp;b=2 </loc></url>"))).otherwise(F.concat(F.lit("<x:url><x:loc><![CDATA[https://s/"), "p_partkey", F.lit("?a=1&b=2]]></x:loc></x:url>")))
    maps = part.groupBy("p_brand").agg(F.concat_ws("", F.collect_list(located)).alias("x"))
    files = maps.select(F.concat(F.lit("m/"), "p_brand").alias("url"), F.concat(F.lit("<!DOCTYPE html><html><urlset>"), "x", F.lit("</urlset></html>")).alias("content"))
    listed = maps.agg(F.concat_ws("", F.collect_list(F.concat(F.lit("<sitemap><loc>m/"), "p_brand", F.lit("</loc></sitemap>")))).alias("x"))
    index = listed.select(F.lit("index").alias("url"), F.concat(F.lit("<sitemapindex>"), "x", F.lit("<sitemap><loc>index</loc></sitemap></sitemapindex>")).alias("content"))
    return sitemaps.sitemap_urls(files.unionByName(index), index.select("url"))


@_query("""WITH h AS (SELECT url, regexp_extract(url, '^[^/]*//([^/?#]*)', 1) AS host, url LIKE 'https://%' AS crawled FROM pages)
SELECT url, 0 AS level FROM h WHERE crawled UNION ALL SELECT DISTINCT url, 1 FROM h WHERE NOT crawled AND host IN (SELECT host FROM h WHERE crawled)""")
def merged_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages (those of https) and the seeds (all pages) of their hosts that were not crawled."""
    pages = _table(spark, sf_dir, "pages")
    return links.merge_seeds(pages.filter(urls.is_https(F.col("url"))).select("url", F.lit(0).alias("level")), pages)


@_query(f"""SELECT url, regexp_replace(left(replace(h, ':', '_') || '_' || CASE WHEN p = '' THEN 'index' ELSE replace(replace(p, '/', '_'), '.', '_') END, 200), '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') AS file
FROM (SELECT url, regexp_extract(url, '^[^/]*//([^/?#]*)', 1) AS h, trim({_PATH}, '/') AS p FROM pages)""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("url", urls.file_name(F.col("url")).alias("file"))


@_query("SELECT url, NOT (contains(lower(url), 'login') OR contains(lower(url), 'cart') OR contains(lower(url), 'a')) AS safe FROM pages")
def safe_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("url", reports.is_safe_target(F.col("url"), ("login", "CART", "a")).alias("safe"))


@_query("SELECT 'd' || o_custkey AS domain, o_orderdate AS crawl_ts, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL")
def resumable_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paused crawls; open orders stand for them."""
    states = _built(spark, sf_dir, "orders", "SELECT 'd' || o_custkey AS domain, o_orderdate AS crawl_ts, CASE WHEN o_orderstatus = 'O' THEN 'paused' ELSE 'done' END AS status FROM {orders}")
    return reports.resumable(states).groupBy("domain", "crawl_ts").agg(F.count(F.lit(1)).alias("n"))


# -- interfaces ----------------------------------------------------------------------------------------------------------------

_LOG = """SELECT CASE l_linenumber % 3 WHEN 0 THEN 'POST' ELSE 'GET' END AS method, l_orderkey * 10 + l_linenumber AS seq, CASE l_linenumber % 4 WHEN 0 THEN 'xhr' WHEN 1 THEN 'document' WHEN 2 THEN 'fetch' ELSE 'image' END AS kind,
CASE l_linenumber % 5 WHEN 0 THEN 'https://a.x/api/v1/parts/' || l_partkey WHEN 1 THEN 'https://b.x/static/app.js' WHEN 2 THEN 'https://b.x/users/' || l_suppkey || '/orders?q=1' WHEN 3 THEN 'https://a.x/page' ELSE 'https://a.x/api/v1/parts/' || l_partkey || '?x=2' END AS url,
CASE WHEN l_linenumber % 2 = 0 THEN '{"id":' || l_partkey || ',"tags":["a"],"at":"2026-01-01T00:00:00Z"}' END AS body FROM {lineitem}"""
_CALLS = """c AS (SELECT method, seq, url, body, regexp_replace(regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1), '[0-9]+$|[0-9]+/orders', '#') AS p, regexp_extract(url, '^[^/]*//([^/?#]*)', 1) AS host FROM l
WHERE NOT url LIKE '%.js' AND (kind IN ('xhr', 'fetch') OR url LIKE '%/api/%')), d AS (SELECT *, CASE WHEN p LIKE '/api%' THEN '/api/v1/parts/{id_3}' WHEN p LIKE '/users%' THEN '/users/{id_1}/orders' ELSE p END AS path FROM c)"""


@_query(f"""WITH l AS ({_LOG.replace('{lineitem}', 'lineitem')}), {_CALLS}, r AS (SELECT *, row_number() OVER (PARTITION BY method, path ORDER BY seq) AS n FROM d)
SELECT method, path, split_part(path, '/', 2) AS tag, count(*) AS calls, array_to_string(list_sort(list(DISTINCT host)), ',') AS hosts, string_agg(url, ' ' ORDER BY n) FILTER (WHERE n <= 3) AS examples FROM r GROUP BY method, path""")
def api_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints of a request log with calls, hosts and first addresses; lineitem stands for the log."""
    log = spark.sql(_LOG.replace('{"id"', '{{"id"').replace(':00Z"}', ':00Z"}}'), lineitem=_table(spark, sf_dir, "lineitem"))
    return api.endpoints(log).select("method", "path", "tag", "calls", _text("hosts"), F.array_join("examples", " ").alias("examples"))


@_query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '{\"properties\": {\"id\": {\"example\": ' || p_partkey || ', \"type\": \"integer\"}}, \"type\": \"object\"}' WHEN 1 THEN '{\"items\": {\"example\": \"a@b.c\", \"format\": \"email\", \"type\": \"string\"}, \"type\": \"array\"}' WHEN 2 THEN '{\"type\": \"null\"}' WHEN 3 THEN '{\"example\": \"https://x\", \"format\": \"uri\", \"type\": \"string\"}' END AS schema FROM part")
def json_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas of JSON bodies, null where a body is none."""
    body = F.expr("CASE p_partkey % 5 WHEN 0 THEN '{\"id\": ' || p_partkey || '}' WHEN 1 THEN '[\"a@b.c\", 1]' WHEN 2 THEN 'null' WHEN 3 THEN '\"https://x\"' ELSE '{' END")
    return _table(spark, sf_dir, "part").select("p_partkey", api.infer_schema(body).alias("schema"))


#: Probed pages: address, content type, text, and what they are.
_PROBES = (("https://x/openapi.json", "text/plain", '{"openapi": "3.0"}', "spec"), ("https://x/docs", "text/html", "<div id=swagger-ui>", "ui"), ("https://x/a", "application/json", '{"swagger" : "2.0"}', "spec"), ("https://x/", "text/html", "hello", "other"), ("https://x/b.yaml", "text/plain", "title: x", "other"))


@_query("SELECT page_id, CASE page_id % 5 " + " ".join(f"WHEN {i} THEN '{x[3]}'" for i, x in enumerate(_PROBES)) + " END AS kind FROM pages")
def api_documentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("page_id") % len(_PROBES) + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in _PROBES]), at)
    return _table(spark, sf_dir, "pages").select("page_id", api.looks_like_documentation(pick(0), pick(1), pick(2)).alias("kind"))


# -- selectors -----------------------------------------------------------------------------------------------------------------

#: Selectors, their stability and confidence.
_SELECTORS = (
    ('[data-testid="x"]', "very_high", 0.98), ("#main", "high", 0.9), ("#item123456", "low", 0.4), (".card", "medium", 0.6), (".css-1a2b", "very_low", 0.3), ('[name="q"]', "high", 0.92),
    ('[aria-label="Menu"]', "medium", 0.85), ('[rel="x"]', "medium", 0.5), ("div > p", "medium", 0.5),
)


@_query("SELECT page_id, CASE page_id % 9 " + " ".join(f"WHEN {i} THEN '{x[1]}'" for i, x in enumerate(_SELECTORS)) + " END AS stability, CASE page_id % 9 " + " ".join(f"WHEN {i} THEN {x[2]}::DOUBLE" for i, x in enumerate(_SELECTORS)) + " END AS confidence FROM pages")
def selector_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    selector = F.element_at(F.array(*[F.lit(x[0]) for x in _SELECTORS]), (F.col("page_id") % len(_SELECTORS) + 1).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", selectors.stability(selector).alias("s")).select("page_id", "s.*")


_PRIMARY = "SELECT 's' || s_suppkey AS site, CASE s_suppkey % 2 WHEN 0 THEN 'price' ELSE 'title' END AS purpose, '#p' || s_suppkey AS selector, s_suppkey % 7 AS success, s_suppkey % 5 AS failure, (s_suppkey % 10) / 10.0D AS confidence FROM {supplier}"
_OTHERS = "SELECT 's' || s_suppkey AS site, CASE s_suppkey % 2 WHEN 0 THEN 'price' ELSE 'title' END AS purpose, '.a' || p AS alternative, CASE WHEN p = 2 THEN 9 ELSE s_suppkey % 11 END AS success, CASE WHEN p = 2 THEN s_suppkey % 3 ELSE 1 END AS failure, p AS pos FROM {supplier}"


def _alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(*[F.lit(p) for p in (1, 2, 3)])).alias("p"))
    return spark.sql(_OTHERS, supplier=rows)


_PROMOTED = """a AS (SELECT s_suppkey AS k, CASE s_suppkey % 2 WHEN 0 THEN 'price' ELSE 'title' END AS purpose, unnest([1, 2, 3]) AS p, s_suppkey % 7 AS s0, s_suppkey % 5 AS f0 FROM supplier),
b AS (SELECT *, CASE WHEN p = 2 THEN 9 ELSE k % 11 END AS s, CASE WHEN p = 2 THEN k % 3 ELSE 1 END AS f, CASE WHEN s0 + f0 = 0 THEN 0.5::DOUBLE ELSE s0::DOUBLE / (s0 + f0) END AS own FROM a),
d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s::DOUBLE / (s + f) DESC, p) AS n FROM b WHERE s + f >= 5 AND s::DOUBLE / (s + f) > 0.8 AND s::DOUBLE / (s + f) > own)"""


@_query(f"WITH {_PROMOTED} SELECT 's' || k AS site, purpose, '#p' || k AS selector, '.a' || p AS promoted FROM d WHERE n = 1")
def selector_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternatives that are due to replace their selector; suppliers stand for sites."""
    return selectors.promotions(_built(spark, sf_dir, "supplier", _PRIMARY), _alternatives(spark, sf_dir))


@_query(f"WITH {_PROMOTED}, w AS (SELECT * FROM d WHERE n = 1) SELECT 's' || s_suppkey AS site, CASE WHEN w.k IS NULL THEN '#p' || s_suppkey ELSE '.a' || w.p END AS selector, CAST(CASE WHEN w.k IS NULL THEN s_suppkey % 7 ELSE w.s END AS BIGINT) AS success FROM supplier LEFT JOIN w ON w.k = s_suppkey")
def selectors_after_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary, _ = selectors.promote(_built(spark, sf_dir, "supplier", _PRIMARY), _alternatives(spark, sf_dir))
    return primary.select("site", "selector", F.col("success").cast("long").alias("success"))


@_query(f"""SELECT 's' || s_suppkey AS site, selector, {_sql_r('confidence')} AS confidence FROM (
SELECT s_suppkey, '#p' || s_suppkey AS selector, (s_suppkey % 10) / 10.0::DOUBLE AS confidence FROM supplier UNION ALL SELECT s_suppkey, '.a' || unnest([1, 2, 3]), (s_suppkey % 10) / 10.0::DOUBLE * 0.8::DOUBLE FROM supplier
UNION ALL SELECT s_suppkey, '[itemprop=price]', 0.3::DOUBLE FROM supplier WHERE s_suppkey % 2 = 0)""")
def selector_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = spark.createDataFrame([("price", "[itemprop=price]"), ("price", ".a1"), ("other", "x")], "purpose string, selector string")
    found = selectors.fallbacks(_built(spark, sf_dir, "supplier", _PRIMARY), _alternatives(spark, sf_dir), patterns)
    return found.select("site", "selector", _r("confidence").alias("confidence"))


@_query("""SELECT 'e' || s_suppkey AS element, selector, attribute, stability, confidence, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY confidence DESC, i) AS INTEGER) AS rank FROM (
SELECT s_suppkey, '[data-testid="t' || s_suppkey || '"]' AS selector, 'data-testid' AS attribute, 'very_high' AS stability, 0.99::DOUBLE AS confidence, 0 AS i FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, '#main', 'id', 'high', 0.9::DOUBLE, 5 FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, '[role="button"]', 'role', 'medium', 0.8::DOUBLE, 9 FROM supplier
UNION ALL SELECT s_suppkey, 'button:has-text("Go")', 'text', 'medium', 0.75::DOUBLE, 99 FROM supplier WHERE s_suppkey % 5 = 0)""")
def selector_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of elements by attributes and text, best first; generated ids are left out."""
    rows = _built(spark, sf_dir, "supplier", """SELECT 'e' || s_suppkey AS element, CASE WHEN s_suppkey % 5 = 0 THEN 'button' ELSE 'div' END AS tag, 'Go' AS text,
        map_from_entries(array_compact(array(if(s_suppkey % 2 = 0, struct('data-testid' as key, 't' || s_suppkey as value), null), struct('id' as key, if(s_suppkey % 3 = 0, 'main', 'item123456') as value), struct('role' as key, 'button' as value)))) AS attributes FROM {supplier}""")
    return selectors.stable_candidates(rows).select("element", "selector", "attribute", "stability", "confidence", "rank")


@_query("SELECT 'e' || s_suppkey AS element, CASE WHEN s_suppkey % 10 > 5 THEN '#s' || s_suppkey WHEN s_suppkey % 2 = 0 THEN '.g' || s_suppkey END AS selector FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0".replace("FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0", "FROM supplier"))
def best_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _built(spark, sf_dir, "supplier", "SELECT 'e' || s_suppkey AS element, '#s' || s_suppkey AS selector, (s_suppkey % 10) / 10.0D AS confidence FROM {supplier}")
    generated = _built(spark, sf_dir, "supplier", "SELECT 'e' || s_suppkey AS element, CASE WHEN s_suppkey % 2 = 0 THEN '.g' || s_suppkey END AS selector, 1 AS rank FROM {supplier}")
    return selectors.best_selector(stored, generated)


@_query("""SELECT 'e' || s_suppkey AS element, CASE s_suppkey % 4 WHEN 0 THEN '#main' WHEN 1 THEN '[name="q"]' WHEN 2 THEN '.css-1a2b' ELSE '#item123456' END AS selector, CASE s_suppkey % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'replace' WHEN 2 THEN 'review' ELSE 'review' END AS action FROM supplier""")
def selector_reanalysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored selectors that are kept, replaced by a better candidate, or left to review."""
    current = _built(spark, sf_dir, "supplier", "SELECT 'e' || s_suppkey AS element, CASE s_suppkey % 4 WHEN 0 THEN '#main' WHEN 1 THEN '.css-1a2b' WHEN 2 THEN '.css-1a2b' ELSE '#item123456' END AS selector FROM {supplier}")
    candidates = _built(spark, sf_dir, "supplier", "SELECT 'e' || s_suppkey AS element, '[name=\"q\"]' AS selector, CASE s_suppkey % 4 WHEN 1 THEN 0.92D ELSE 0.2D END AS confidence FROM {supplier}")
    return selectors.reanalyse(current, candidates)


@_query("SELECT o_orderpriority AS engine, array_to_string(list_sort(list_filter((SELECT list(DISTINCT o_orderstatus) FROM orders), lambda x: NOT list_contains(own, x))), ',') AS missing FROM (SELECT o_orderpriority, list(DISTINCT o_orderstatus) AS own FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority LIKE '1%') AND NOT (o_orderstatus <> 'F' AND o_orderpriority LIKE '3%') GROUP BY o_orderpriority) WHERE len(own) < (SELECT count(DISTINCT o_orderstatus) FROM orders)")
def missing_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What some engines can do and others cannot; priorities and states of orders stand for engines and capabilities."""
    rows = _table(spark, sf_dir, "orders").filter("NOT (o_orderstatus = 'P' AND o_orderpriority LIKE '1%') AND NOT (o_orderstatus <> 'F' AND o_orderpriority LIKE '3%')")
    return selectors.missing_capabilities(rows.select(F.col("o_orderpriority").alias("engine"), F.col("o_orderstatus").alias("capability"))).select("engine", _text("missing"))


_ENGINES = "SELECT 'u' || user_id AS url, 'e' || event_id AS engine, event_id AS pos, event_id % 5 <> 0 AS success, event_type AS data FROM {events}"


@_query(f"""WITH r AS ({_ENGINES.replace('{events}', 'events')}), x AS (SELECT *, first_value(success) OVER w AS s0, first_value(data) OVER w AS d0, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY url ORDER BY pos))
SELECT url, engine, CASE WHEN success <> s0 THEN 'success' ELSE 'data' END AS kind FROM x WHERE n > 1 AND (success <> s0 OR success AND s0 AND data <> d0)""")
def engine_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engines whose outcome or data differ from the first; the events of a user stand for engines on a page."""
    return selectors.engine_discrepancies(_built(spark, sf_dir, "events", _ENGINES))


@_query("SELECT 'o' || l_orderkey AS url, bool_and(l_returnflag <> 'R') AS all_passed, count(*) AS engines FROM lineitem GROUP BY l_orderkey")
def engine_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _built(spark, sf_dir, "lineitem", "SELECT 'o' || l_orderkey AS url, l_returnflag <> 'R' AS success FROM {lineitem}")
    return selectors.engine_verdicts(rows)


@_query("SELECT url, CASE WHEN regexp_matches(url, '^https://[^/]*[0-3]') THEN 'digits' WHEN regexp_matches(url, '^https?://[a-m]') THEN 'early' WHEN regexp_matches(url, '^http') THEN 'any' END AS profile FROM pages")
def page_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = spark.createDataFrame([("http", "any", 3), ("https://[^/]*[0-3]", "digits", 1), ("https?://[a-m]", "early", 2)], "pattern string, profile string, pos int")
    return selectors.page_profiles(_table(spark, sf_dir, "pages"), patterns)


@_query("SELECT 'u' || user_id AS site, event_type AS page, count(*) AS visits, max(ts) AS last_seen FROM events GROUP BY ALL")
def profile_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _built(spark, sf_dir, "events", "SELECT 'u' || user_id AS site, event_type AS page, ts FROM {events}")
    return selectors.profile_visits(rows)


# -- requests, caches, texts ---------------------------------------------------------------------------------------------------


@_query("""SELECT event_id, NOT ok AND (status IN (429, 503) OR status BETWEEN 500 AND 599 OR kind IN ('timeout', 'network', 'dns')) AS backs_off FROM (SELECT event_id, event_id % 3 = 0 AS ok, CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN 404 ELSE 0 END AS status,
CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'other' WHEN 2 THEN 'dns' ELSE '' END AS kind FROM events)""")
def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _built(spark, sf_dir, "events", "SELECT event_id, event_id % 3 = 0 AS ok, CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN 404 ELSE 0 END AS status, CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'other' WHEN 2 THEN 'dns' END AS kind FROM {events}")
    return rows.select("event_id", classify.backs_off(F.col("ok"), F.col("status"), F.col("kind")).alias("backs_off"))


_FAILED = "SELECT 'u' || user_id AS url, event_id AS seq, event_type <> 'error' AND event_id % 3 <> 0 AS success, CASE event_id % 4 WHEN 0 THEN 'net::ERR_NAME_NOT_RESOLVED' WHEN 1 THEN repeat('long ', 150) ELSE 'timeout' END AS error, CASE event_id % 2 WHEN 0 THEN 'network' ELSE 'timeout' END AS error_type, value / 100 AS response_time FROM {events}"
_FAILED_SQL = _FAILED.replace("{events}", "events")


@_query(f"""WITH l AS ({_FAILED_SQL}), b AS (SELECT url, arg_max(error, seq) AS error, count(*) AS retries FROM l WHERE NOT success GROUP BY url)
SELECT url, left(error, 500) AS error, retries, retries < 3 AND NOT contains(lower(error), 'net::err_name_not_resolved') AS retryable FROM b""")
def failure_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last failure of every address, and whether another attempt is worth it; events stand for the log."""
    return requests.failures(_built(spark, sf_dir, "events", _FAILED))


@_query(f"WITH l AS ({_FAILED_SQL}) SELECT error_type, count(*) AS failures FROM l WHERE NOT success GROUP BY error_type")
def failures_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.failures_by_type(_built(spark, sf_dir, "events", _FAILED))


@_query(f"WITH l AS ({_FAILED_SQL}) SELECT url, count(*) AS uses, {_sql_r('count(*) FILTER (WHERE success)::DOUBLE / count(*)')} AS success_rate, {_sql_r('count(*) FILTER (WHERE NOT success)::DOUBLE / count(*)')} AS error_rate FROM l GROUP BY url")
def use_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = requests.use_statistics(_built(spark, sf_dir, "events", _FAILED), "url")
    return found.select("url", "uses", _r("success_rate").alias("success_rate"), _r("error_rate").alias("error_rate"))


@_query("SELECT 'u' || user_id AS domain, event_id AS seq, floor((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000.0::DOUBLE + 0.5005::DOUBLE) AS gap_ms FROM events")
def request_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time between the requests of a domain; users stand for domains."""
    rows = _built(spark, sf_dir, "events", "SELECT 'u' || user_id AS domain, event_id AS seq, ts FROM {events}")
    return requests.gaps(rows).select("domain", "seq", F.floor(F.col("gap") * 1000 + 0.5005).cast("double").alias("gap_ms"))


@_query("""SELECT o_orderkey AS key FROM (SELECT o_orderkey, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS b FROM orders) WHERE b <= 50000000""")
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entries within a size; orders stand for entries, prices for bytes."""
    rows = _built(spark, sf_dir, "orders", "SELECT o_orderkey AS key, o_orderdate AS created_at, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM {orders}")
    return requests.evict_oldest(rows, 50_000_000).select("key")


@_query("SELECT count(*) AS entries, CAST(sum(o_orderkey % 7) AS BIGINT) AS hits, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes FROM orders")
def cache_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advice.cache_statistics(_built(spark, sf_dir, "orders", "SELECT o_orderkey % 7 AS hit_count, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM {orders}"))


@_query(f"SELECT count(*) AS lookups, count(*) FILTER (WHERE event_id % 3 = 0) AS hits, {_sql_r('count(*) FILTER (WHERE event_id % 3 = 0)::DOUBLE / count(*)')} AS rate FROM events")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.hit_rate(_built(spark, sf_dir, "events", "SELECT event_id % 3 = 0 AS hit FROM {events}")).withColumn("rate", _r("rate"))


@_query("""SELECT key, CASE WHEN bool_or(fresh) THEN max(created) FILTER (WHERE fresh) ELSE max(created) END AS created FROM (SELECT o_custkey AS key, o_orderkey AS created, o_orderstatus = 'O' AS fresh FROM orders) GROUP BY key""")
def cache_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache after new entries (open orders); customers stand for keys."""
    rows = _built(spark, sf_dir, "orders", "SELECT o_custkey AS key, o_orderkey AS created_at, o_orderstatus AS state FROM {orders}")
    return advice.put_cache(rows.filter("state <> 'O'"), rows.filter("state = 'O'")).select("key", F.col("created_at").alias("created"))


@_query("SELECT doc_id, sha256(coalesce(text, '') || coalesce(lang, '')) AS key, left(sha256(coalesce(text, '')), 16) AS hash FROM documents")
def prompt_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return _table(spark, sf_dir, "documents").select("doc_id", advice.prompt_key(t, F.col("lang")).alias("key"), advice.prompt_hash(t).alias("hash"))


@_query("SELECT p_partkey, 'p' || p_partkey AS title, CAST(p_size AS VARCHAR) AS score FROM part")
def response_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed fields of line-wise responses; the first line of a key counts."""
    response = F.concat(F.lit("Title : p"), "p_partkey", F.lit("\nnoise\nSCORE: "), F.col("p_size").cast("string"), F.lit("\r\nscore: 0\nother: x"))
    fields = advice.parse_fields(response, ("title", "score"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.try_element_at(fields, F.lit("title")).alias("title"), F.try_element_at(fields, F.lit("score")).alias("score"))


@_query("SELECT phase, count(*) AS pages, CAST(sum(s) AS BIGINT) AS seconds FROM (SELECT unnest(['load', 'parse']) AS phase, unnest([l_linenumber, l_linenumber * 2]) AS s FROM lineitem) GROUP BY phase")
def phase_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time by phase over all pages; line numbers stand for seconds."""
    rows = _built(spark, sf_dir, "lineitem", "SELECT map('load', l_linenumber, 'parse', l_linenumber * 2) AS timing FROM {lineitem}")
    return reports.phase_totals(rows).select("phase", "pages", F.col("seconds").cast("long").alias("seconds"))


@_query("""SELECT page_id, 'perf' AS component, CAST(page_id % 9 AS DOUBLE) AS measured, CASE WHEN page_id % 9 > 6 THEN 'critical' ELSE 'warning' END AS severity, 'High' AS confidence FROM pages WHERE page_id % 9 > 3""")
def threshold_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of measurements beyond a threshold."""
    rows = _built(spark, sf_dir, "pages", "SELECT CAST(page_id AS STRING) AS url, page_id % 9 AS m FROM {pages}")
    found = evidence.threshold_evidence(rows, "perf", "slow", F.col("m"), ">", 3, "s", F.when(F.col("m") > 6, "critical").otherwise("warning"))
    return found.select(F.col("url").cast("long").alias("page_id"), "component", "measured", "severity", "confidence")


@_query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'High' ELSE 'Low' END AS confidence, true AS ai_generated FROM pages")
def capped_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of model output: capped unless it was validated."""
    rows = _built(spark, sf_dir, "pages", "SELECT CAST(page_id AS STRING) AS url, 'f' AS finding, page_id % 4 = 0 AS ok FROM {pages}")
    return evidence.model_evidence(rows, "model", F.col("ok"), "Low").select(F.col("url").cast("long").alias("page_id"), "confidence", "ai_generated")


@_query("SELECT 'technical' AS component, CASE page_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS finding, count(*) AS records, CASE page_id % 3 WHEN 0 THEN 'High' ELSE 'Medium' END AS confidence FROM pages GROUP BY ALL")
def evidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined confidence of findings: one measured, one of a model in part, one of middling rows."""
    rows = _built(spark, sf_dir, "pages", """SELECT 'technical' AS component, CASE page_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS finding, CASE WHEN page_id % 3 = 2 THEN 'Medium' ELSE 'High' END AS confidence, page_id % 3 = 1 AS ai_generated FROM {pages}""")
    return evidence.combined_confidence(rows)


@_query("""SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN s < 0 THEN 'Unknown range' WHEN s <= 29 THEN '0-29 maps to College Graduate' WHEN s BETWEEN 30 AND 49 THEN '30-49 maps to College' WHEN s BETWEEN 50 AND 59 THEN '50-59 maps to 10-12th Grade' WHEN s BETWEEN 60 AND 69 THEN '60-69 maps to 8-9th Grade'
WHEN s BETWEEN 70 AND 79 THEN '70-79 maps to 7th Grade' WHEN s BETWEEN 80 AND 89 THEN '80-89 maps to 6th Grade' WHEN s BETWEEN 90 AND 100 THEN '90-100 maps to 5th Grade' ELSE 'Unknown range' END AS band FROM (SELECT *, l_quantity * 2 - CASE WHEN l_linenumber = 2 THEN 0.5 ELSE 0 END AS s FROM lineitem)""")
def grade_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of the band of a reading ease; quantities of lineitem stand for scores."""
    score = F.col("l_quantity") * 2 - F.when(F.col("l_linenumber") == 2, 0.5).otherwise(0)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", tx.grade_range(score).alias("band"))


# -- what a browser records, and what is said of it ---------------------------------------------------------------------------

_REQUESTS = """SELECT 'https://h.x/' || l_orderkey AS url, l_linenumber AS seq, CASE l_linenumber % 4 WHEN 0 THEN 'https://cdn' || l_suppkey % 30 || '.y/f' WHEN 1 THEN '/local' ELSE 'https://h.x/a' || l_partkey END AS request_url,
CASE l_linenumber % 5 WHEN 0 THEN 'font' WHEN 1 THEN 'script' WHEN 2 THEN 'stylesheet' WHEN 3 THEN 'image' ELSE 'other' END AS kind, CASE WHEN l_linenumber < 7 THEN CAST(l_quantity AS BIGINT) END AS bytes FROM {lineitem}"""
_REQUESTS_SQL = _REQUESTS.replace("{lineitem}", "lineitem")


@_query(f"""WITH r AS ({_REQUESTS_SQL}) SELECT url, CAST(coalesce(sum(bytes) FILTER (WHERE kind = 'stylesheet'), 0) AS BIGINT) AS css_bytes, CAST(coalesce(sum(bytes) FILTER (WHERE kind = 'script'), 0) AS BIGINT) AS js_bytes,
CAST(coalesce(sum(bytes), 0) AS BIGINT) AS page_bytes FROM r GROUP BY url""")
def captured_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every page by kind; the lines of an order stand for its requests."""
    return captures.weights(_built(spark, sf_dir, "lineitem", _REQUESTS)).select("url", "css_bytes", "js_bytes", "page_bytes")


@_query(f"""WITH r AS ({_REQUESTS_SQL}) SELECT url, array_to_string(list_sort(list(DISTINCT regexp_extract(request_url, '//([^/]*)', 1)))[1:20], ',') AS domains, count(*) AS requests, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM r WHERE request_url LIKE 'https://cdn%' GROUP BY url""")
def captured_third_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = captures.third_parties(_built(spark, sf_dir, "lineitem", _REQUESTS))
    return found.select("url", F.array_join("third_party_domains", ",").alias("domains"), F.col("third_party_requests").alias("requests"), F.col("third_party_bytes").alias("bytes"))


@_query(f"""WITH r AS ({_REQUESTS_SQL}) SELECT url, string_agg(left(request_url, 100) || ' ' || coalesce(bytes, 0), ',' ORDER BY seq, left(request_url, 100), coalesce(bytes, 0)) AS fonts FROM r WHERE kind = 'font' GROUP BY url""")
def captured_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = captures.web_fonts(_built(spark, sf_dir, "lineitem", _REQUESTS))
    return found.select("url", F.array_join(F.transform("web_fonts", lambda x: F.concat(x["url"], F.lit(" "), x["size"])), ",").alias("fonts"))


_CONSOLE = "SELECT 'u' || user_id AS url, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'error' WHEN event_id % 5 = 0 THEN 'info' ELSE 'warning' END AS level, event_type || repeat('x', CAST(event_id % 600 AS INT)) AS message FROM {events}"


@_query(f"""WITH c AS ({_CONSOLE.replace('{events}', 'events')}), r AS (SELECT *, row_number() OVER (PARTITION BY url, level ORDER BY seq) AS n FROM c)
SELECT url, string_agg(left(message, 500), '|' ORDER BY n) FILTER (WHERE level = 'error' AND n <= 10) AS errors, string_agg(left(message, 500), '|' ORDER BY n) FILTER (WHERE level = 'warning' AND n <= 10) AS warnings FROM r GROUP BY url""")
def captured_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten errors and warnings of every page; events stand for console lines."""
    found = captures.console_lists(_built(spark, sf_dir, "events", _CONSOLE))
    return found.select("url", F.nullif(F.array_join("console_errors", "|"), F.lit("")).alias("errors"), F.nullif(F.array_join("console_warnings", "|"), F.lit("")).alias("warnings"))


@_query("SELECT url, page_id % 3 > 0 AS was_redirected, CASE WHEN page_id % 3 > 0 THEN url || ' ' || url || '/moved' ELSE '' END AS chain, CASE WHEN page_id % 3 > 0 THEN 1 ELSE 0 END AS redirect_count FROM pages")
def captured_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = _built(spark, sf_dir, "pages", "SELECT url, CASE page_id % 3 WHEN 0 THEN url ELSE url || '/moved' END AS final_url FROM {pages}")
    return captures.redirects(visits).select("url", "was_redirected", F.array_join("redirect_chain", " ").alias("chain"), "redirect_count")


@_query(f"""WITH r AS ({_REQUESTS_SQL}), t AS (SELECT url, count(*) AS requests, CAST(count(DISTINCT regexp_extract(request_url, '//([^/]*)', 1)) AS INTEGER) AS domains FROM r WHERE request_url LIKE 'https://cdn%' GROUP BY url)
SELECT url, requests, domains FROM t ORDER BY requests DESC, CAST(substr(url, 13) AS BIGINT), url LIMIT 10""")
def third_party_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten pages with most third-party requests."""
    found = captures.third_parties(_built(spark, sf_dir, "lineitem", _REQUESTS))
    return site.third_party_pages(found.withColumn("crawl_seq", F.substring("url", 13, 20).cast("long")))


#: Summary rows by number, for the texts of recommendations.
_SUMMARY = """SELECT s_suppkey AS id, CAST(s_suppkey % 101 AS DOUBLE) AS image_share, s_suppkey % 3 AS heavy_images, CAST(s_suppkey % 61 AS DOUBLE) AS js_share, s_suppkey % 2 AS heavy_js, s_suppkey % 4 AS heavy_css, s_suppkey % 5 AS bloated, s_suppkey % 4000 * 1024 AS avg_bytes,
CAST(s_suppkey % 101 AS DOUBLE) AS modern_share, s_suppkey % 3 AS without_dimensions, s_suppkey % 2 AS should_be_lazy, CAST(s_suppkey % 101 AS DOUBLE) AS alt_share, s_suppkey % 1000 * 1024 AS saving, CAST(30 AS DOUBLE) AS saving_share,
s_suppkey % 3 AS three_plus, s_suppkey % 7 * 1000 AS ms, s_suppkey % 20 AS chains, s_suppkey % 8 AS longest, CAST(s_suppkey % 60 AS DOUBLE) AS share, CAST(s_suppkey % 40 AS DOUBLE) AS avg_requests, s_suppkey % 5 AS analytics, s_suppkey % 9 AS advertising,
s_suppkey % 2 = 0 AS has_robots, s_suppkey % 3 AS robots_errors, s_suppkey % 3 = 0 AS has_sitemap, s_suppkey % 4 AS sitemaps, s_suppkey % 5 AS orphans, s_suppkey % 6 AS broken, s_suppkey % 100 AS efficiency FROM {supplier}"""


def _said(*pairs: tuple[str, str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {test} THEN printf('{text}'{values and ', ' + values}) END" for test, text, values in pairs) + "], lambda x: x IS NOT NULL), ' | ')"


_RESOURCES = _said(
    ("image_share > 50", "Images make up %.1f%% of all bytes: serve WebP or AVIF and load images lazily.", "image_share"), ("heavy_images > 0", "%d pages load more than 1.0 MB of images: resize and compress them.", "heavy_images"),
    ("js_share > 30", "Scripts make up %.1f%% of all bytes: split bundles and defer what is not needed at first.", "js_share"), ("heavy_js > 0", "%d pages load more than 500 KB of scripts: look for code that is never used.", "heavy_js"),
    ("heavy_css > 0", "%d pages load more than 200 KB of styles: drop unused rules, inline the critical ones.", "heavy_css"), ("bloated > 0", "%d pages weigh more than 2.0 MB and will be slow on mobile networks.", "bloated"),
    ("avg_bytes / 1024 > 1500", "A page weighs %.0f KB on average, above 1500 KB: begin with the largest kind.", "avg_bytes / 1024.0::DOUBLE"),
)
_IMAGE_TEXTS = _said(
    ("modern_share < 50", "%.1f%% of images are in a modern format: converting the others saves about 30%%.", "modern_share"), ("without_dimensions > 0", "%d images have no width or height: give them both, so that the layout does not shift.", "without_dimensions"),
    ("should_be_lazy > 0", "About %d images come after the first 3 of their page and are not lazy: add loading=lazy.", "should_be_lazy"), ("alt_share < 90", "%.1f%% of images have an alternative text: write one for the rest.", "alt_share"),
    ("saving > 512000", "Modern formats would save about %.0f KB, %.1f%% of all image bytes.", "saving / 1024.0::DOUBLE, saving_share"),
)
_MOVES = _said(
    ("three_plus > 0", "%d chains have 3 hops or more: redirect once, to the last address.", "three_plus"), ("ms > 1000", "Redirects cost about %.1f seconds in all, at 100 ms a hop: link to the last address.", "ms / 1000.0::DOUBLE"),
    ("chains > 10", "%.0f%% of pages are redirected: look at how addresses are made.", "chains * 100.0::DOUBLE / 100"), ("longest > 4", "The longest chain has %d hops: mend it first.", "longest"),
)
_THIRD = _said(
    ("share > 30", "Third parties make up %.1f%% of all bytes, above 30%%: host the important ones yourself.", "share"), ("avg_requests > 20", "A page makes %.1f requests to third parties, above 20: join or defer them.", "avg_requests"),
    ("analytics > 2", "%d analytics services are in use: keep fewer.", "analytics"), ("advertising > 5", "%d advertising services are in use: load them late.", "advertising"),
)
_CRAWL = _said(
    ("NOT has_robots", "Put a robots.txt at the root of the host.", ""), ("has_robots AND robots_errors > 0", "Mend %d errors of robots.txt.", "robots_errors"), ("NOT has_sitemap", "Write a sitemap and submit it to search engines.", ""),
    ("has_sitemap", "Make sure that all %d sitemaps can be fetched and are valid.", "sitemaps"), ("NOT has_sitemap", "Name the sitemap in robots.txt.", ""), ("orphans > 0", "Link to %d pages that nothing links to, or list them in the sitemap.", "orphans"),
    ("broken > 0", "Mend %d broken links.", "broken"), ("efficiency < 70", "Crawls waste requests: mend broken links and redirects first.", ""),
)


@_query(f"WITH s AS ({_SUMMARY.replace('{supplier}', 'supplier')}) SELECT id, {_RESOURCES} AS resources, {_IMAGE_TEXTS} AS images, {_MOVES} AS redirects, {_THIRD} AS third_parties, {_CRAWL} AS crawlability FROM s")
def recommendation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is recommended for summary rows of every kind, with the measured values."""
    rows = _built(spark, sf_dir, "supplier", _SUMMARY)
    said = {"resources": advice.resource_advice(), "images": advice.image_advice(), "redirects": advice.redirect_advice(F.lit(100)), "third_parties": advice.third_party_advice(F.col("analytics"), F.col("advertising")), "crawlability": advice.crawlability_advice()}
    return rows.select("id", *[F.array_join(v, " | ").alias(k) for k, v in said.items()])


@_query("""SELECT 'r' || o_custkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 90 / 10.0::DOUBLE DESC, o_orderkey) AS INTEGER) AS place, 'do ' || o_orderkey AS action, o_orderkey % 90 / 10.0::DOUBLE AS ice FROM orders""")
def ice_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored lines of every response by falling ICE; the orders of a customer stand for lines."""
    line = F.concat(F.lit("[I:8 C:7 E:9 = ICE:"), (F.col("o_orderkey") % 90 / 10.0).cast("string"), F.lit("] do "), F.col("o_orderkey").cast("string"))
    responses = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("response"))
    scored = advice.by_ice(advice.scored_lines(responses.select(F.concat(F.lit("r"), "o_custkey").alias("id"), "response")))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ice"), "pos"))
    return scored.select("id", place.alias("place"), "action", "ice")


@_query("""SELECT 's' || s_suppkey AS site, purpose, selector, CAST(pos AS BIGINT) AS pos FROM supplier, (VALUES ('react', 'submit_button', '[data-testid=''submit'']', 0), ('react', 'submit_button', 'button[type=''submit'']', 1), ('react', 'submit_button', '[role=''button''][type=''submit'']', 2),
('react', 'input_field', '[data-testid=''input'']', 0), ('react', 'input_field', 'input[name]', 1), ('react', 'input_field', '[role=''textbox'']', 2), ('react', 'form', 'form[data-testid]', 0), ('react', 'form', 'form[name]', 1), ('react', 'form', '[role=''form'']', 2),
('vue', 'submit_button', '[data-cy=''submit'']', 0), ('vue', 'submit_button', 'button[type=''submit'']', 1), ('vue', 'submit_button', '.v-btn[type=''submit'']', 2), ('vue', 'input_field', '[data-cy=''input'']', 0), ('vue', 'input_field', '.v-text-field input', 1), ('vue', 'input_field', 'input[name]', 2)) v(f, purpose, selector, pos)
WHERE f = CASE s_suppkey % 3 WHEN 0 THEN 'react' WHEN 1 THEN 'vue' ELSE 'none' END""")
def framework_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _built(spark, sf_dir, "supplier", "SELECT 's' || s_suppkey AS site, CASE s_suppkey % 3 WHEN 0 THEN 'react' WHEN 1 THEN 'vue' ELSE 'none' END AS framework FROM {supplier}")
    return selectors.framework_patterns(sites)


@_query("""WITH c AS (SELECT l_orderkey, l_linenumber AS rank, '#' || l_linenumber AS selector, l_linenumber % 3 = l_orderkey % 3 AS dynamic FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)), k AS (SELECT * FROM c WHERE NOT dynamic), m AS (SELECT l_orderkey, min(rank) AS rank FROM k GROUP BY ALL)
SELECT 'o' || m.l_orderkey AS element, '#' || m.rank AS selector, coalesce((SELECT string_agg(selector, ',' ORDER BY k.rank) FROM k WHERE k.l_orderkey = m.l_orderkey AND k.rank BETWEEN 2 AND 4 AND k.rank <> m.rank), '') AS alternatives FROM m""")
def stored_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selector to keep of each element and its alternatives; lines of an order stand for candidates."""
    rows = _built(spark, sf_dir, "lineitem", "SELECT DISTINCT 'o' || l_orderkey AS element, '#' || l_linenumber AS selector, 0.5D AS confidence, l_linenumber AS rank, l_linenumber % 3 = l_orderkey % 3 AS dynamic FROM {lineitem}")
    return selectors.stored_selectors(rows).select("element", "selector", _text("alternatives"))


@_query(f"SELECT count(DISTINCT s_nationkey) AS sites, count(*) AS selectors, {_sql_r('avg((s_suppkey % 10) / 10.0::DOUBLE)')} AS confidence, (SELECT string_agg(f || ':' || n, ',' ORDER BY f) FROM (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'react' WHEN 1 THEN 'vue' ELSE 'none' END AS f, count(*) AS n FROM supplier GROUP BY ALL)) AS frameworks FROM supplier")
def library_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = _built(spark, sf_dir, "supplier", "SELECT s_nationkey AS site, (s_suppkey % 10) / 10.0D AS confidence FROM {supplier}")
    kinds = _built(spark, sf_dir, "supplier", "SELECT CASE s_suppkey % 3 WHEN 0 THEN 'react' WHEN 1 THEN 'vue' ELSE 'none' END AS framework FROM {supplier}")
    found = selectors.library_statistics(library, kinds)
    return found.select("sites", "selectors", _r("confidence").alias("confidence"), F.array_join(F.transform(F.map_entries("frameworks"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",").alias("frameworks"))


@_query("""SELECT 'h' || s_suppkey AS host, CAST(CASE s_suppkey % 4 WHEN 0 THEN 3128 WHEN 1 THEN 8080 ELSE 1080 END AS INTEGER) AS port, CASE s_suppkey % 4 WHEN 1 THEN 'https' WHEN 2 THEN 'socks5' ELSE 'http' END AS kind,
CASE s_suppkey % 4 WHEN 0 THEN 'me' WHEN 2 THEN 'u' END AS username, CASE s_suppkey % 4 WHEN 0 THEN 'pw' WHEN 2 THEN 'p' END AS password FROM supplier""")
def proxy_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of proxies in both notations, with comments between; suppliers stand for proxies."""
    lines = _built(spark, sf_dir, "supplier", """SELECT explode(array(CASE s_suppkey % 4 WHEN 0 THEN ' http://me:pw@h' || s_suppkey || ':3128 ' WHEN 1 THEN 'https://h' || s_suppkey WHEN 2 THEN 'h' || s_suppkey || ',1080,socks5,u,p' ELSE 'h' || s_suppkey || ',1080' END, '# note', '', 'noise')) AS value FROM {supplier}""")
    return lists.proxies(lines)


@_query("SELECT page_id, CAST(i AS INTEGER) AS pos, '{\"timing\":' || i || '}' AS item FROM (SELECT page_id, unnest(range(page_id % 4)) AS i FROM pages)")
def lighthouse_screenshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.transform(F.sequence(F.lit(0), F.col("page_id") % 4 - 1), lambda i: F.concat(F.lit('{"timing":'), i, F.lit("}")))
    report = F.concat(F.lit('{"audits":{"screenshot-thumbnails":{"details":{"items":['), F.when(F.col("page_id") % 4 > 0, F.array_join(item, ",")).otherwise(""), F.lit("]}}}}"))
    return lighthouse.screenshots(_table(spark, sf_dir, "pages").select("page_id", report.alias("json")), "json")


# -- archives, profiles, dates -------------------------------------------------------------------------------------------------


@_query(f"WITH {_F} SELECT 'example.com' AS domain, crawl_ts, count(*) AS pages, CAST(sum(length(title)) AS BIGINT) AS titles FROM f, (VALUES ('2026-01-01'), ('2026-02-01')) v(crawl_ts) WHERE crawl_ts = '2026-01-01' OR url LIKE 'https://%' GROUP BY crawl_ts")
def crawl_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two crawls written to an archive and read back, the later one of https pages only."""
    pages, path = furnished(spark, sf_dir), scratch_path(spark, "archive")
    archives.write_crawl(pages, path, "example.com", "2026-01-01")
    archives.write_crawl(pages.filter(urls.is_https(F.col("url"))), path, "example.com", "2026-02-01")
    back = archives.read_crawls(spark, path)
    counted = archives.crawls(back)
    titles = back.groupBy("domain", "crawl_ts").agg(F.sum(F.length("title")).alias("titles"))
    return counted.join(titles, ["domain", "crawl_ts"])


@_query(f"WITH {_F} SELECT url, title FROM f WHERE url LIKE 'https://%'")
def latest_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the newest crawl of an archive."""
    pages, path = furnished(spark, sf_dir), scratch_path(spark, "archive")
    archives.write_crawl(pages, path, "example.com", "2026-01-01")
    archives.write_crawl(pages.filter(urls.is_https(F.col("url"))), path, "example.com", "2026-02-01")
    return archives.latest(archives.read_crawls(spark, path)).select("url", "title")


@_query(f"WITH {_F} SELECT url, title, CAST(n_h2 AS BIGINT) AS h2 FROM f")
def pages_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table written as JSON and read back."""
    path = scratch_path(spark, "json")
    furnished(spark, sf_dir).drop("content_text").write.json(path)
    rows = spark.read.schema(schema.PAGE).json(path)
    return rows.select("url", "title", F.size("h2_tags").cast("long").alias("h2"))


@_query("SELECT 'd' || c_nationkey AS domain, CAST(to_timestamp(c_custkey * 86400) AT TIME ZONE 'UTC' AS TIMESTAMP) AS crawl_date, CAST(round(c_acctbal) AS DOUBLE) AS technical_score FROM customer WHERE c_nationkey = 3")
def snapshot_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots saved to a table, and the history of one domain read from it; customers stand for snapshots."""
    path = scratch_path(spark, "snapshots")
    rows = _built(spark, sf_dir, "customer", "SELECT 'd' || c_nationkey AS domain, CAST(timestamp_seconds(c_custkey * 86400) AS TIMESTAMP_NTZ) AS crawl_date, round(c_acctbal) AS technical_score FROM {customer}")
    archives.save_snapshots(rows, path)
    return archives.history(archives.read_snapshots(spark, path), "d3").select("domain", "crawl_date", "technical_score")


@_query("SELECT p_partkey, left(sha256('{\"name\":\"' || p_name || '\",\"size\":' || p_size || '}'), 16) AS hash FROM part")
def profile_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", selectors.profile_hash(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))).alias("hash"))


@_query(f"WITH {_F} SELECT url, CAST(length(title) AS INTEGER) AS title_length, CAST(length(description) AS INTEGER) AS description_length, CAST(least(n_h1, 5) AS INTEGER) AS h1 FROM f")
def input_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is told of a page."""
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    found = furnished(spark, sf_dir).select("url", advice.input_summary(none("content_text"), none("title"), none("description"), F.col("h1_tags"), F.col("keywords")).alias("s"))
    return found.select("url", "s.title_length", "s.description_length", F.size("s.h1").alias("h1"))


@_query("SELECT 's' || page_id AS site, CASE WHEN url LIKE 'https://%' THEN 'vue' ELSE CASE page_id % 6 " + " ".join(f"WHEN {i} THEN '{x[1]}'" for i, x in enumerate(_FRAMEWORKS)) + " END END AS framework FROM pages")
def framework_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frameworks of sites, as set where they are, else as found."""
    markup = F.element_at(F.array(*[F.lit(x[0]) for x in _FRAMEWORKS]), (F.col("page_id") % len(_FRAMEWORKS) + 1).cast("int"))
    pages = _table(spark, sf_dir, "pages")
    site_ = F.concat(F.lit("s"), "page_id").alias("site")
    return selectors.framework_of(pages.select(site_, markup.alias("html")), pages.filter(urls.is_https(F.col("url"))).select(site_, F.lit("vue").alias("framework")))


@_query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01') >= 90 THEN 'archived' ELSE 'kept' END AS state FROM orders) GROUP BY state")
def selector_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors that stay and that are archived after ninety unused days; orders stand for them."""
    rows = _built(spark, sf_dir, "orders", "SELECT date_trunc('DAY', o_orderdate) AS last_used, date_trunc('DAY', o_orderdate) AS created_at FROM {orders}")
    kept, gone = selectors.cleanup(rows, "1998-06-01 00:00:00")
    both = kept.select(F.lit("kept").alias("state")).unionByName(gone.select(F.lit("archived").alias("state")))
    return both.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 100 WHEN 1 THEN 80 WHEN 2 THEN 50 WHEN 3 THEN 30 ELSE 10 END AS specificity FROM pages")
def selector_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*[F.lit(x) for x in ("very_high", "high", "medium", "low", "very_low")]), (F.col("page_id") % 5 + 1).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", selectors.specificity(level).alias("specificity"))


@_query("SELECT key, hit_count FROM (SELECT o_orderkey AS key, o_orderkey % 50 AS hit_count, left(sha256('prompt ' || o_orderpriority), 16) AS h FROM orders) WHERE left(h, 8) = left(sha256('prompt 1-URGENT'), 8) ORDER BY hit_count DESC, key LIMIT 5")
def similar_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most used entries with the beginning of a prompt's hash; priorities stand for prompts."""
    cache = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 50).alias("hit_count"), advice.prompt_hash(F.concat(F.lit("prompt "), "o_orderpriority")).alias("prompt_hash"))
    return advice.similar_prompts(cache, "prompt 1-URGENT").select("key", "hit_count")


@_query("SELECT event_id, strftime(ts, '%Y-%m-%d_%H%M%S') AS crawl_id, strftime(ts, '%B %-d, %Y %H:%M') AS shown, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2026-01-01' ELSE date_trunc('second', ts) END AS parsed FROM events")
def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl ids, shown dates and dates read back, with a substitute where the text is none."""
    written = F.when(F.col("event_id") % 3 == 0, "no date").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    substitute = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return _table(spark, sf_dir, "events").select("event_id", reports.crawl_id(F.col("ts")).alias("crawl_id"), reports.format_date(F.col("ts")).alias("shown"), reports.parse_date(written, substitute).cast("timestamp_ntz").alias("parsed"))


@_query(f"""WITH c AS ({_CONSOLE.replace('{events}', 'events')}), e AS (SELECT url, row_number() OVER (PARTITION BY url ORDER BY seq) AS n, left(message, 100) AS m FROM c WHERE level = 'error'), f AS (SELECT * FROM e WHERE n <= 10)
SELECT url, count(*) AS errors, string_agg(m, '|' ORDER BY n) FILTER (WHERE n <= 5) AS messages FROM f GROUP BY url ORDER BY errors DESC, CAST(substr(url, 2) AS BIGINT) LIMIT 20""")
def console_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty pages with most errors and their first messages."""
    lists_ = captures.console_lists(_built(spark, sf_dir, "events", _CONSOLE))
    rows = site.console_rows(lists_.withColumn("crawl_seq", F.substring("url", 2, 20).cast("long")))
    return reports.console_pages(rows).select("url", "errors", F.array_join("messages", "|").alias("messages"))


@_query("""SELECT DISTINCT path, '{"method":"' || lower(method) || '","tags":["' || tag || '"],"calls":' || calls || '}' AS operation FROM (SELECT '/c/' || 'x' AS path, 'GET' AS method, 'c' AS tag, count(*) AS calls FROM customer)""")
def interface_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The description of an endpoint without bodies; customers stand for calls."""
    found = _table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("calls")).select(F.lit("/c/x").alias("path"), F.lit("GET").alias("method"), F.lit("c").alias("tag"), "calls", F.array().cast("array<string>").alias("bodies"))
    return api.interface_description(found)


# -- thresholds, versions, health ----------------------------------------------------------------------------------------------


@_query(f"WITH {_F} SELECT count(*) FILTER (WHERE title <> '' AND length(title) < 10) AS short_titles, count(*) FILTER (WHERE length(title) > 45) AS long_titles, count(*) FILTER (WHERE load_time > 1) AS slow_pages, count(*) FILTER (WHERE {_WORDS} < 200) AS thin_pages FROM f")
def threshold_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technical checks under thresholds set from the environment; a bad value leaves its default."""
    set_ = Thresholds.from_env({"SEO_THRESHOLD_TITLE_MIN": "10", "SEO_THRESHOLD_TITLE_MAX": "45", "SEO_THRESHOLD_SLOW_SECONDS": "1", "SEO_THRESHOLD_THIN_WORDS": "200", "SEO_THRESHOLD_DESCRIPTION_MIN": "many"})
    issues = technical.issue_rows(furnished(spark, sf_dir), set_)
    n = lambda kind: F.count_if(F.col("issue_type") == kind)
    return issues.agg(n("short_title").alias("short_titles"), n("long_title").alias("long_titles"), n("slow_page").alias("slow_pages"), n("thin_content").alias("thin_pages"))


@_query("SELECT event_id, CASE WHEN event_type LIKE 'c%' THEN 'begins with c' WHEN regexp_matches(event_type, 'r$') THEN 'ends with r' ELSE 'Other' END AS kind FROM events")
def own_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Console lines by a pattern set of one's own."""
    return _table(spark, sf_dir, "events").select("event_id", classify.console_error(F.col("event_type"), {"begins with c": "^C", "ends with r": "R$"}).alias("kind"))


@_query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size || '.1.20' WHEN 1 THEN '3.' || p_size || '.0' END AS version FROM part")
def script_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.expr("CASE p_partkey % 3 WHEN 0 THEN '/lib-' || p_size || '.1.20.min.js' WHEN 1 THEN 'https://x/jquery/3.' || p_size || '.0/j.js?v=9.9.9' ELSE '/app.js?v=1.2' END")
    return _table(spark, sf_dir, "part").select("p_partkey", technologies.version(source).alias("version"))


@_query("SELECT 'unused-javascript' AS id, count(*) AS pages, CAST(sum(page_id % 700) AS DOUBLE) AS savings_ms, CAST(sum(page_id % 1000) AS BIGINT) AS savings_bytes, CAST(count(*) * 2 AS BIGINT) AS items FROM pages HAVING count(*) > 0")
def lighthouse_opportunity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.opportunity_rollup(lighthouse.opportunities(_reports(spark, sf_dir)))
    return found.select("id", "pages", "savings_ms", "savings_bytes", F.col("items").cast("long").alias("items"))


@_query(f"""WITH {_F} SELECT url, {' || '.join(f"'{n}=' || CASE WHEN {v} IS NULL THEN 'unknown' WHEN {v} <= {a} THEN 'good' WHEN {v} <= {b} THEN 'needs-improvement' ELSE 'poor' END || ' '" for n, v, a, b in (('lcp', '(performance * 60)', 2500, 4000), ('fcp', '(performance * 40)', 1800, 3000), ('tbt', '(performance * 9)', 200, 600), ('si', '(performance * 70)', 3400, 5800), ('tti', '(performance * 90)', 3800, 7300)))} AS status FROM f""")
def lab_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of every laboratory metric, from multiples of a score."""
    score = F.col("lighthouse_performance")
    parts = [x for name, k in (("lcp", 60), ("fcp", 40), ("tbt", 9), ("si", 70), ("tti", 90)) for x in (F.lit(f"{name}="), vitals.lab_status(name, score * k), F.lit(" "))]
    return furnished(spark, sf_dir).select("url", F.concat(*parts).alias("status"))


_PROXY = "SELECT 'p' || user_id AS proxy, event_id AS seq, event_id % 7 < 4 AS success, event_id % 29 = 6 AS blocked FROM {events}"


@_query(f"""WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY proxy ORDER BY seq) AS n FROM ({_PROXY.replace('{events}', 'events')})),
f(proxy, seq, n, good, streak, blocks, health) AS (SELECT proxy, seq, n, CAST(success AS INT), CASE WHEN success THEN 0 ELSE 1 END, CASE WHEN NOT success AND blocked THEN 1 ELSE 0 END, 'healthy' FROM l WHERE n = 1
UNION ALL SELECT l.proxy, l.seq, l.n, f.good + CAST(l.success AS INT), CASE WHEN l.success THEN 0 ELSE f.streak + 1 END, f.blocks + CASE WHEN NOT l.success AND l.blocked THEN 1 ELSE 0 END,
  CASE WHEN l.success THEN CASE WHEN f.health = 'degraded' AND (f.good + 1.0) / l.n > 0.9 THEN 'healthy' ELSE f.health END
  WHEN f.blocks + CASE WHEN l.blocked THEN 1 ELSE 0 END >= 3 THEN 'retired' WHEN f.streak + 1 >= 5 THEN 'unhealthy' WHEN f.streak + 1 >= 2 THEN 'degraded' ELSE f.health END FROM f JOIN l ON l.proxy = f.proxy AND l.n = f.n + 1)
SELECT proxy, seq, health FROM f""")
def proxy_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The health of every proxy after each use; users stand for proxies, events for uses."""
    return requests.proxy_health(_built(spark, sf_dir, "events", _PROXY)).select("proxy", "seq", "health")


@_query(f"""WITH {_F}, {_ISSUES}, r AS (SELECT split_part(x, ':', 1) AS issue_type, i.url, row_number() OVER (PARTITION BY split_part(x, ':', 1) ORDER BY page_id, i.url) AS rank FROM i JOIN f ON f.url = i.url)
SELECT issue_type, CAST(rank AS INTEGER) AS rank, url FROM r WHERE rank <= 5""")
def furnished_issue_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five pages of every issue in crawl order, as a text report shows them."""
    return technical.issue_samples(technical.issue_rows(furnished(spark, sf_dir))).select("issue_type", "rank", "url")


@_query(f"""WITH {_F}, {_ISSUES}, s AS (SELECT split_part(x, ':', 1) AS k, count(*) AS pages, count(*) FILTER (WHERE x LIKE '%:critical') AS critical FROM i GROUP BY k)
SELECT k || ': ' || pages || ' pages, ' || critical || ' critical' AS line FROM s""")
def issue_report_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head line of every issue in the text report."""
    lines = reports.issue_lines(technical.issue_rows(written(furnished(spark, sf_dir).drop("content_text"), "pages")))
    return lines.filter("no = 0").select("line")


_MEASURED = "CASE WHEN k LIKE '%_title' AND k NOT LIKE 'missing%' AND k NOT LIKE 'dup%' THEN length(title) WHEN k IN ('short_description', 'long_description') THEN length(description) WHEN k = 'multiple_h1' THEN n_h1 WHEN k = 'images_without_alt' THEN no_alt WHEN k = 'thin_content' THEN words WHEN k = 'slow_page' THEN round(load_time, 2) WHEN k = 'duplicate_title' THEN t.n ELSE 0 END"


@_query(rf"""WITH {_F}, {_ISSUES}, k AS (SELECT url, split_part(x, ':', 1) AS k, split_part(x, ':', 2) AS severity FROM i),
s AS (SELECT k, count(*) AS pages, count(*) FILTER (WHERE severity = 'critical') AS critical FROM k GROUP BY k),
p AS (SELECT *, row_number() OVER (ORDER BY pages DESC, k) AS place FROM s),
r AS (SELECT k, severity, k.url, regexp_replace(CAST(CAST({_MEASURED} AS DECIMAL(20, 2)) AS VARCHAR), '\.?0+$', '') AS measured, row_number() OVER (PARTITION BY k ORDER BY page_id, k.url) AS no FROM k JOIN g ON g.url = k.url LEFT JOIN t USING (title))
SELECT CAST(place AS INTEGER) AS place, 0 AS no, k || ': ' || pages || ' pages, ' || critical || ' critical' AS line FROM p
UNION ALL SELECT CAST(place AS INTEGER), CAST(no AS INTEGER), '  - ' || url || ' (' || measured || ', ' || severity || ')' FROM r JOIN p USING (k) WHERE no <= 5
UNION ALL SELECT CAST(place AS INTEGER), 6, '  ... and ' || (pages - 5) || ' more' FROM p WHERE pages > 5""")
def issue_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the text report of issues."""
    return reports.issue_lines(technical.issue_rows(written(furnished(spark, sf_dir).drop("content_text"), "pages")))


_NUMBERS = {"pages": "count(*)", "words": "sum(words)", "avg_words": "sum(words) // count(*)", "images": "sum(n_images)", "without_title": "count(*) FILTER (title = '')", "without_description": "count(*) FILTER (description = '')", "without_h1": "count(*) FILTER (n_h1 = 0)"}


@_query(f"""WITH {_F}, {_ISSUES} SELECT 0 AS section, 0::BIGINT AS no, 'crawl of x' AS line
{" ".join(f"UNION ALL SELECT 1, {n}, '{k}: ' || format('{{:,}}', CAST({v} AS BIGINT)) FROM g{' HAVING count(*) > 0' if n > 1 else ''}" for n, (k, v) in enumerate(_NUMBERS.items(), 1))}
UNION ALL SELECT 2, page_id, '- ' || url || coalesce(' [' || nullif(array_to_string(list_filter([CASE WHEN title = '' THEN 'no title' END, CASE WHEN description = '' THEN 'no description' END, CASE WHEN n_h1 = 0 THEN 'no h1' END, CASE WHEN words < 300 THEN 'thin' END], lambda x: x IS NOT NULL), ', '), '') || ']', '') FROM g""")
def crawl_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text summary of a crawl: its numbers and every page in crawl order."""
    return reports.crawl_lines(written(furnished(spark, sf_dir).drop("content_text"), "pages"), "x")
