"""The query slate: names, plans and oracle SQL of the page analytics queries.

Page queries run the HTML extractor on ``pages``; their SQL reads the same facts with regular expressions.  Where
``pages`` has no such data, a projection of another table gives an operator varied input; it renames columns only, and
the docstring names it.  Doubles are rounded half up on both sides.
"""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, scores, technologies, urls, vitals
from ..functions import text as tx
from ..operators import advice, content, evidence, links, measurements, requests, selectors, site, statistics, technical
from ..sources import html, site_files
from ..sources.shared import written

QUERIES = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_table(_table(spark, sf_dir, "pages"))


def _silver(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The page table without page texts, or ``columns`` of it, written once for queries that read it in several branches."""
    pages = _pages(spark, sf_dir)
    return written(pages.select(*columns) if columns else pages.drop("content_text"), "pages")


def _r(value: Column | str, digits: int = 4) -> Column:
    return tx.round_half_up(F.col(value) if isinstance(value, str) else value, digits)


#: Page facts by regular expressions, for oracles.
_PAGE_SQL = r"""
p AS (
  SELECT page_id, url, html,
    trim(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&')) AS title,
    len(regexp_extract_all(html, '<h1[^>]*>')) AS n_h1,
    list_filter(regexp_split_to_array(regexp_replace(replace(html, '"</p>"', '""'), '<[^>]*>', ' ', 'g'), '\s+'), lambda x: x <> '') AS words,
    regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS hrefs,
    regexp_extract(url, '^[^/]*//([^/?#]*)', 1) AS host,
    regexp_extract(url, '^[^/]*//[^/?#]*', 0) AS root
  FROM pages)
"""
_EDGES = "e AS (SELECT page_id, url AS src, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos, root, host FROM p)"
_PATH = "regexp_replace(regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')"
_SYLLABLES = "greatest(1, len(regexp_extract_all(lower({w}), '[aeiou]+')) - CASE WHEN lower({w}) LIKE '%e' THEN 1 ELSE 0 END)"


def _sql_r(value: str, digits: int = 4) -> str:
    return f"(floor(({value}) * {10**digits}.0::DOUBLE + 0.5) / {10**digits}.0::DOUBLE)"


# -- pages -------------------------------------------------------------------------------------------------------------


@_query(f"""
WITH {_PAGE_SQL},
i AS (
  SELECT url, unnest(list_filter([
    CASE WHEN title = '' THEN 'missing_title' END, CASE WHEN title <> '' AND length(title) < 30 THEN 'short_title' END, CASE WHEN length(title) > 60 THEN 'long_title' END,
    'missing_description', CASE WHEN n_h1 = 0 THEN 'missing_h1' END, CASE WHEN n_h1 > 1 THEN 'multiple_h1' END, CASE WHEN len(words) < 300 THEN 'thin_content' END, 'missing_canonical'], lambda x: x IS NOT NULL)) AS issue_type,
    len(words) AS n FROM p),
d AS (SELECT title FROM p WHERE title <> '' GROUP BY title HAVING count(*) > 1),
a AS (
  SELECT issue_type, CASE WHEN issue_type IN ('missing_title', 'missing_description', 'missing_h1') OR issue_type = 'thin_content' AND n <= 100 THEN 1 ELSE 0 END AS c FROM i
  UNION ALL SELECT 'duplicate_title', CASE WHEN (SELECT count(*) FROM p q WHERE q.title = p.title) = 2 THEN 0 ELSE 1 END FROM p WHERE title IN (SELECT title FROM d))
SELECT issue_type, count(*) AS pages, CAST(sum(c) AS BIGINT) AS critical FROM a GROUP BY issue_type
""")
def technical_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technical issues of all pages by type, with how many are critical."""
    return technical.issue_totals(technical.issue_rows(_silver(spark, sf_dir)))


@_query(f"WITH {_PAGE_SQL} SELECT url, CAST(length(title) AS DOUBLE) AS measured, CASE WHEN length(title) < 30 THEN 'short_title' ELSE 'long_title' END AS issue_type FROM p WHERE title <> '' AND (length(title) < 30 OR length(title) > 60)")
def title_length_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return technical.issue_rows(_pages(spark, sf_dir)).filter(F.col("issue_type").isin("short_title", "long_title")).select("url", "measured", "issue_type")


@_query(f"WITH {_PAGE_SQL} SELECT title, count(*) AS pages, CASE WHEN count(*) = 2 THEN 'warning' ELSE 'critical' END AS severity FROM p WHERE title <> '' GROUP BY title HAVING count(*) > 1")
def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return technical.duplicate_titles(_pages(spark, sf_dir))


@_query(f"WITH {_PAGE_SQL} SELECT url, CAST(n_h1 AS BIGINT) AS h1, len(words) AS word_count, CAST(len(hrefs) AS BIGINT) AS links, title FROM p")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extractor against regular expressions: headings, words, links and title of every page."""
    return _pages(spark, sf_dir).select("url", F.size("h1_tags").cast("long").alias("h1"), "word_count", F.size("hrefs").cast("long").alias("links"), "title")


@_query("SELECT url FROM pages WHERE url NOT LIKE 'https://%'")
def non_https_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("url").filter(~urls.is_https(F.col("url")))


@_query(f"""WITH {_PAGE_SQL} SELECT url, len(flags) AS n_flags, greatest(0, 100 - len(flags) * 10) AS health, array_to_string(flags, ',') AS flags FROM (
SELECT url, list_filter([CASE WHEN title = '' THEN 'title' END, 'desc', CASE WHEN n_h1 = 0 THEN 'h1' END, 'canonical', CASE WHEN len(words) < 300 THEN 'thin' END, 'security'], lambda x: x IS NOT NULL) AS flags FROM p)""")
def page_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags and health of every page; without response headers every page lacks security."""
    return technical.page_matrix(_pages(spark, sf_dir)).select("url", F.col("n_flags").cast("long").alias("n_flags"), F.col("health").cast("long").alias("health"), F.array_join("flags", ",").alias("flags"))


@_query(f"""WITH {_PAGE_SQL} SELECT issue_type, priority, pages FROM (
SELECT 'missing_description' AS issue_type, 'critical' AS priority, count(*) AS pages FROM p UNION ALL
SELECT 'missing_title', 'critical', count(*) FROM p WHERE title = '' UNION ALL SELECT 'missing_h1', 'high', count(*) FROM p WHERE n_h1 = 0 UNION ALL
SELECT 'multiple_h1', 'medium', count(*) FROM p WHERE n_h1 > 1 UNION ALL SELECT 'thin_content', 'medium', count(*) FROM p WHERE len(words) < 300 UNION ALL
SELECT 'missing_canonical', 'medium', count(*) FROM p UNION ALL SELECT 'short_title', 'medium', count(*) FROM p WHERE title <> '' AND length(title) < 30 UNION ALL
SELECT 'long_title', 'medium', count(*) FROM p WHERE length(title) > 60 UNION ALL
SELECT 'duplicate_title', 'high', count(*) FROM p WHERE title <> '' AND title IN (SELECT title FROM p GROUP BY title HAVING count(*) > 1)) WHERE pages > 0""")
def prioritised_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return technical.prioritised(technical.issue_rows(_silver(spark, sf_dir)))


@_query(f"WITH {_PAGE_SQL}, {_EDGES} SELECT src, regexp_extract(CASE WHEN href LIKE '/%' THEN root || href ELSE href END, '^[^#]*', 0) AS dst, CAST(pos AS INTEGER) AS pos FROM e")
def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.link_edges(_pages(spark, sf_dir))


@_query(f"""WITH {_PAGE_SQL}, {_EDGES}, d AS (SELECT src, pos, regexp_extract(CASE WHEN href LIKE '/%' THEN root || href ELSE href END, '^[^#]*', 0) AS dst FROM e)
SELECT src, count(*) AS n, string_agg(dst, ' ' ORDER BY pos) AS broken FROM d WHERE dst NOT IN (SELECT url FROM pages) GROUP BY src""")
def broken_internal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.broken_internal_links(_silver(spark, sf_dir, "crawl_seq", "url", "links")).select("src", F.size("broken").cast("long").alias("n"), F.array_join("broken", " ").alias("broken"))


@_query(f"""WITH {_PAGE_SQL}, {_EDGES}, d AS (SELECT DISTINCT regexp_extract(CASE WHEN href LIKE '/%' THEN root || href ELSE href END, '^[^#]*', 0) AS dst FROM e),
f AS (SELECT host, root FROM p ORDER BY page_id LIMIT 1)
SELECT DISTINCT url FROM p, f WHERE url NOT IN (SELECT dst FROM d, f WHERE regexp_extract(dst, '^[^/]*//([^/?#]*)', 1) = f.host) AND url <> f.root AND url <> f.root || '/'""")
def orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.orphan_pages(_silver(spark, sf_dir, "crawl_seq", "url", "links"))


@_query(f"""WITH {_PAGE_SQL}, {_EDGES} SELECT DISTINCT dst AS url FROM (SELECT regexp_extract(CASE WHEN href LIKE '/%' THEN root || href ELSE href END, '^[^#]*', 0) AS dst FROM e)
WHERE dst NOT IN (SELECT url FROM pages)""")
def crawlability_undiscovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.undiscovered(_silver(spark, sf_dir, "url", "links"), limit=None)


@_query(f"""WITH {_PAGE_SQL}, {_EDGES} SELECT p.url, CAST(count(href) FILTER (WHERE NOT x) AS BIGINT) AS internal, CAST(count(href) FILTER (WHERE x) AS BIGINT) AS external
FROM p LEFT JOIN (SELECT src, href, href LIKE 'http%' AND regexp_extract(href, '^[^/]*//([^/?#]*)', 1) <> host AS x FROM e) l ON l.src = p.url GROUP BY p.url""")
def internal_external_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.link_counts(_silver(spark, sf_dir, "url", "hrefs"))


@_query(f"""WITH {_PAGE_SQL}, {_EDGES} SELECT DISTINCT root || CASE WHEN length(h) > 1 AND h LIKE '%/' THEN left(h, length(h) - 1) ELSE h END AS url
FROM (SELECT root, regexp_replace(regexp_extract(href, '^[^#]*', 0), ';[^/?#]*(\\?|$)', '\\1') AS h FROM e WHERE href LIKE '/%')
WHERE url NOT IN (SELECT CASE WHEN length(regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1)) > 1 AND u LIKE '%/' THEN left(u, length(u) - 1) ELSE u END FROM (SELECT url, regexp_extract(url, '^[^#]*', 0) AS u FROM pages))
AND NOT regexp_matches(lower(regexp_extract(h, '^[^?]*', 0)), '/policies/|/checkout/|/cart/|/payment/|/pay/|/order/|/account/login|/account/register|/signin|/signup|/login|/register')
AND NOT regexp_matches(lower(regexp_extract(h, '^[^?]*', 0)), '\\.(pdf|jpg|jpeg|png|gif|svg|webp|zip|tar|gz|mp4|mp3|avi|mov|doc|docx|xls|xlsx|ppt|pptx|css|js|xml|json|ico|woff|woff2|ttf)$')""")
def frontier_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.frontier_links(_silver(spark, sf_dir, "url", "links"))


@_query("""
WITH RECURSIVE e AS (SELECT DISTINCT 'n' || c_nationkey AS src, 'c' || c_custkey AS dst FROM customer UNION SELECT 'c' || o_custkey, 'p' || l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
r(node, level) AS (SELECT 'n0', 0 UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.node WHERE r.level < 16)
SELECT node, min(level) AS level FROM r GROUP BY node""")
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first levels from a nation over its customers, the parts they ordered, these parts' suppliers, and the
    suppliers' nations, until nothing new is reached."""
    named = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    steps = lambda table, a, b: table.select(named(*a).alias("src"), named(*b).alias("dst"))
    read = lambda name: _table(spark, sf_dir, name)
    bought = read("orders").join(read("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    edges = steps(read("customer"), ("n", "c_nationkey"), ("c", "c_custkey")).unionAll(steps(bought, ("c", "o_custkey"), ("p", "l_partkey")))
    edges = edges.unionAll(steps(read("lineitem"), ("p", "l_partkey"), ("s", "l_suppkey"))).unionAll(steps(read("supplier"), ("s", "s_suppkey"), ("n", "s_nationkey")))
    return links.bfs_levels(edges, spark.range(1).select(F.lit("n0").alias("node")), 1000)


_STRUCTURE = f"""
u AS (SELECT url, {_PATH} AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages),
s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg,
  len(list_distinct(list_transform(list_filter(string_split(q, '&'), lambda x: regexp_matches(x, '^[^=]*=.+')), lambda x: string_split(x, '=')[1]))) AS n_params FROM u),
t AS (SELECT url, list_filter([
  CASE WHEN length(url) > 75 THEN 'too_long' END, CASE WHEN url NOT LIKE 'https://%' THEN 'not_https' END, CASE WHEN n_params > 3 THEN 'too_many_parameters' END, CASE WHEN len(seg) > 4 THEN 'too_deep' END,
  CASE WHEN len(list_filter(regexp_extract_all(lower(path), '[a-z]+'), lambda x: NOT list_contains(['and','or','but','the','a','an','of','to','for','with','on','at','from','by','about','as','into','through','is','are','was','were','been','be','have','has','had','do','does','did','will','would','should','could','may','might'], x))) = 0 THEN 'no_keywords' END,
  CASE WHEN regexp_matches(path, '[0-9]{{5,}}') OR regexp_matches(path, '[A-Z]{{3,}}') OR length(path) - length(replace(path, '_', '')) > 2 OR len(list_filter(seg, lambda x: NOT (regexp_matches(lower(x), '^[a-z0-9-]+$') OR regexp_matches(x, '\\.(html|htm|php)$')))) > 0 THEN 'not_readable' END,
  CASE WHEN contains(path, '_') THEN 'underscores' END], lambda x: x IS NOT NULL) AS issues, len(seg) AS depth, n_params FROM s)
"""


@_query(f"WITH {_STRUCTURE} SELECT url, array_to_string(issues, ',') AS issues, CAST(depth AS INTEGER) AS depth, CAST(n_params AS INTEGER) AS parameters FROM t")
def url_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return _table(spark, sf_dir, "pages").select("url", F.array_join(urls.structure_issues(u), ",").alias("issues"), urls.depth(u).alias("depth"), F.size(urls.parameters(u)).alias("parameters"))


@_query(f"WITH {_STRUCTURE} SELECT issue, count(*) AS pages FROM (SELECT unnest(issues) AS issue FROM t) GROUP BY issue ORDER BY pages DESC, issue LIMIT 5")
def url_issue_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent URL issues."""
    return site.issue_frequency(_table(spark, sf_dir, "pages").select(urls.structure_issues(F.col("url")).alias("issues")))


@_query(f"""WITH x AS (SELECT regexp_extract(url, '^[^/]*//([^/?#]*)', 1) AS host, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS s FROM pages),
y AS (SELECT host, s, unnest(range(1, greatest(len(s), 1) + 1)) AS depth FROM x),
z AS (SELECT host, depth, array_to_string(s[1:depth], '/') AS prefix, depth < len(s) AS inner_ FROM y)
SELECT host, CASE WHEN prefix = '' THEN '(homepage)' ELSE prefix END AS prefix, CAST(depth AS INTEGER) AS depth, CASE WHEN bool_or(inner_) THEN 'directory' ELSE 'file' END AS type, count(*) AS pages FROM z GROUP BY host, prefix, depth""")
def site_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.site_tree(_table(spark, sf_dir, "pages"))


@_query("""SELECT url, CASE WHEN length(p) > 1 AND u LIKE '%/' THEN left(u, length(u) - 1) ELSE u END AS normalized FROM
(SELECT url, regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '^[^#]*', 0) AS u FROM pages)""")
def normalized_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("url", urls.normalize(F.col("url")).alias("normalized"))


@_query(f"""SELECT template, count(*) AS pages FROM (SELECT '/' || array_to_string(list_transform(string_split(trim({_PATH}, '/'), '/'), lambda s, i: CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '{{id_' || (i - 1) || '}}'
WHEN regexp_matches(lower(s), '^[a-f0-9]{{24,}}$') THEN '{{token_' || (i - 1) || '}}' ELSE s END), '/') AS template FROM pages) GROUP BY template""")
def path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select(urls.template(urls.path(F.col("url"))).alias("template")).groupBy("template").agg(F.count(F.lit(1)).alias("pages"))


@_query("""SELECT host AS domain, CASE WHEN len(l) >= 3 AND list_contains(['co.uk','com.au','co.nz','co.jp','com.br','co.in','org.uk','net.au','com.mx','co.za','com.sg'], array_to_string(l[-2:], '.')) THEN array_to_string(l[-3:], '.')
ELSE array_to_string(l[-2:], '.') END AS base, pages, CASE WHEN contains(host, 'analytics') THEN 'analytics' WHEN contains(host, 'ads') THEN 'advertising' WHEN contains(host, 'cdn') THEN 'cdn' ELSE 'other' END AS category
FROM (SELECT regexp_extract(url, '^[^/]*//([^/?#]*)', 1) AS host, string_split(lower(regexp_extract(url, '^[^/]*//([^/?#]*)', 1)), '.') AS l, count(*) AS pages FROM pages GROUP BY ALL)""")
def host_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "pages").select(urls.netloc(F.col("url")).alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("pages"))
    return rows.select("domain", urls.base_domain(F.col("domain")).alias("base"), "pages", classify.domain_category(F.col("domain")).alias("category"))


@_query(f"WITH {_PAGE_SQL} SELECT url, CASE WHEN url LIKE 'https://%' THEN 40 ELSE 0 END AS security, 60 AS mobile FROM p")
def security_mobile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without headers and viewports only https earns points, and every page loses 40 for its viewport."""
    p = _pages(spark, sf_dir)
    return p.select("url", scores.security_score(F.col("url"), F.col("headers")).alias("security"), scores.mobile_score(scores.mobile_issues(F.col("viewport"), F.col("total_images"), F.col("images"))).alias("mobile"))


@_query("""SELECT url, lang, charset, array_to_string(list_filter([CASE WHEN lang = '' THEN 'missing_lang' END, CASE WHEN charset = '' THEN 'missing_charset' WHEN lower(charset) <> 'utf-8' THEN 'not_utf8' END], lambda x: x IS NOT NULL), ',') AS issues
FROM (SELECT url, regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset FROM pages)""")
def international_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = site.international_rows(_pages(spark, sf_dir))
    return rows.select("url", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("charset", F.lit("")).alias("charset"), F.array_join("issues", ",").alias("issues"))


@_query(f"""WITH {_PAGE_SQL} SELECT count(*) AS pages, CAST(sum(len(words)) AS BIGINT) AS words, CAST(floor(sum(len(words)) / count(*)) AS BIGINT) AS avg_words, 0::BIGINT AS images,
count(*) FILTER (WHERE title = '') AS without_title, count(*) AS without_description, count(*) FILTER (WHERE n_h1 = 0) AS without_h1 FROM p""")
def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.crawl_summary(_pages(spark, sf_dir))


@_query(f"""WITH {_PAGE_SQL}, v AS (SELECT CASE WHEN least(3, n_h1) = 0 THEN 'good' WHEN least(3, n_h1) <= 2 THEN 'needs-improvement' ELSE 'poor' END AS lcp,
CASE WHEN list_sum(list_transform(regexp_extract_all(html, '<script([^>]*)>', 1), lambda a: CASE WHEN contains(a, 'src=') AND NOT regexp_matches(a, '(async|defer)=') THEN 1 ELSE 0 END)) > 0 THEN 1 ELSE 0 END AS b FROM p)
SELECT 'lcp' AS metric, count(*) FILTER (WHERE lcp = 'good') AS good, count(*) FILTER (WHERE lcp = 'needs-improvement') AS middle, count(*) FILTER (WHERE lcp = 'poor') AS poor FROM v
UNION ALL SELECT 'inp', count(*) FILTER (WHERE b = 0), count(*) FILTER (WHERE b > 0), 0 FROM v UNION ALL SELECT 'cls', count(*), 0, 0 FROM v
UNION ALL SELECT 'overall', count(*) FILTER (WHERE lcp = 'good' AND b = 0), count(*) FILTER (WHERE lcp <> 'poor' AND (lcp <> 'good' OR b > 0)), count(*) FILTER (WHERE lcp = 'poor') FROM v""")
def vitals_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.vitals_summary(statistics.vitals_rows(_pages(spark, sf_dir))).drop("status")


@_query(f"WITH {_PAGE_SQL}, h AS (SELECT md5(array_to_string(words, ' ')) AS h, url FROM p) SELECT count(*) AS pages, count(DISTINCT h) AS texts FROM h")
def content_hash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and distinct texts among them, by the hash of the whitespace-normalised page text."""
    return _pages(spark, sf_dir).agg(F.count(F.lit(1)).alias("pages"), F.countDistinct(F.md5(tx.clean(F.col("content_text")))).alias("texts"))


@_query(f"WITH {_PAGE_SQL} SELECT url, strlen(html) AS html_bytes, length(html) AS html_chars FROM p")
def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _table(spark, sf_dir, "pages")
    return _pages(spark, sf_dir).select("crawl_seq", "url", "html_bytes").join(raw.select(F.col("page_id").alias("crawl_seq"), F.length("html").cast("long").alias("html_chars")), "crawl_seq").drop("crawl_seq")


@_query("""SELECT technology, count(*) AS pages FROM (
SELECT unnest(list_filter([CASE WHEN regexp_matches(lower(html), 'react(\\.js)?') OR contains(lower(html), '__react') THEN 'React' END, CASE WHEN contains(lower(html), 'heap') THEN 'Heap' END,
CASE WHEN regexp_matches(lower(html), 'next(\\.js)?') THEN 'Next.js' END, CASE WHEN contains(lower(html), 'three') THEN 'Three.js' END, CASE WHEN contains(lower(html), 'd3') THEN 'D3.js' END], lambda x: x IS NOT NULL)) AS technology FROM pages) GROUP BY technology""")
def technology_counts_broad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five broad signatures of :func:`technology_counts`, which SQL can follow."""
    return technology_counts(spark, sf_dir).filter(F.col("technology").isin("React", "Heap", "Next.js", "Three.js", "D3.js"))


@_query()
def technology_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every technology; the signature table has no SQL."""
    found = _table(spark, sf_dir, "pages").select(F.explode(technologies.detect(F.col("html"), F.create_map().cast("map<string,string>"))).alias("technology"))
    return found.groupBy("technology").agg(F.count(F.lit(1)).alias("pages"))


@_query(f"SELECT 'technical' AS component, issue_type AS finding, pages AS records, 'High' AS confidence FROM ({ORACLES['technical_issue_counts']})")
def evidence_by_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.combined_confidence(evidence.from_issues(technical.issue_rows(_silver(spark, sf_dir))))


# -- documents ---------------------------------------------------------------------------------------------------------

_READ = f"""
r AS (
  SELECT doc_id, lang, {_WORDS} AS w, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda x: regexp_matches(x, '\\S'))) AS sentences FROM documents),
y AS (SELECT doc_id, lang, len(w) AS words, sentences, coalesce(list_sum(list_transform(w, lambda x: {_SYLLABLES.format(w="x")})), 0) AS syllables, w FROM r),
c AS (SELECT *, CASE WHEN words = 0 OR sentences = 0 THEN 0.0 ELSE greatest(0.0, least(100.0, 206.835::DOUBLE - 1.015::DOUBLE * (words / sentences) - 84.6::DOUBLE * (syllables / words))) END AS score FROM y),
g AS (SELECT *, CASE WHEN words = 0 OR sentences = 0 THEN 'N/A' WHEN score >= 90 THEN '5th Grade' WHEN score >= 80 THEN '6th Grade' WHEN score >= 70 THEN '7th Grade' WHEN score >= 60 THEN '8-9th Grade'
  WHEN score >= 50 THEN '10-12th Grade' WHEN score >= 30 THEN 'College' ELSE 'College Graduate' END AS grade FROM c)
"""


@_query(f"WITH {_READ} SELECT doc_id, CAST(words AS INTEGER) AS words, CAST(sentences AS INTEGER) AS sentences, CAST(syllables AS BIGINT) AS syllables, {_sql_r('score')} AS score, grade FROM g")
def readability_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.readability(_table(spark, sf_dir, "documents")).withColumn("score", _r("score"))


@_query(f"""WITH {_READ}, m AS (SELECT lang, grade, count(*) AS n FROM g GROUP BY ALL)
SELECT lang, (SELECT min(grade) FROM m WHERE m.lang IS NOT DISTINCT FROM g.lang AND n = (SELECT max(n) FROM m k WHERE k.lang IS NOT DISTINCT FROM g.lang)) AS grade FROM (SELECT DISTINCT lang FROM g) g""")
def grade_mode_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.readability(_table(spark, sf_dir, "documents"), keep=("lang",)).groupBy("lang").agg(F.mode("grade", True).alias("grade"))


@_query(f"""WITH {_READ} SELECT lang, count(*) AS pages, {_sql_r('avg(score)')} AS avg_score, {_sql_r('avg(words)')} AS avg_words, count(*) FILTER (WHERE score < 50) AS hard_pages, count(*) FILTER (WHERE words < 300) AS thin_pages FROM g GROUP BY lang""")
def content_quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = content.quality_summary(content.readability(_table(spark, sf_dir, "documents"), keep=("lang",)), ("lang",))
    return found.select("lang", "pages", _r("avg_score").alias("avg_score"), _r("avg_words").alias("avg_words"), "hard_pages", "thin_pages")


_STOP = "[" + ",".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"
_KEYWORDS = f"""
k AS (SELECT doc_id, list_filter(list_transform(list_filter({_WORDS}, lambda x: length(x) > 3), lambda x: trim(lower(x), '.,!?;:"()[]{{}}')), lambda x: NOT list_contains({_STOP}, x)) AS ks FROM documents),
o AS (SELECT doc_id, len(ks) AS total, unnest(ks) AS keyword, generate_subscripts(ks, 1) AS pos FROM k),
n AS (SELECT doc_id, keyword, total, count(*) AS n, min(pos) AS first FROM o GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM n)
"""


@_query(f"WITH {_KEYWORDS} SELECT doc_id, CAST(rank AS INTEGER) AS rank, keyword, n, {_sql_r('n * 100.0::DOUBLE / total')} AS density FROM q WHERE rank <= 10")
def keyword_density_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent keywords of every text."""
    return content.top_keywords(_table(spark, sf_dir, "documents")).withColumn("density", _r("density"))


@_query(f"WITH {_KEYWORDS} SELECT doc_id, keyword, n FROM q WHERE rank <= 10 AND n * 100.0::DOUBLE / total > 3")
def keyword_stuffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.stuffed_keywords(_table(spark, sf_dir, "documents")).select("doc_id", "keyword", "n")


@_query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w, list_filter(list_transform({_WORDS}, lambda x: trim(lower(x), '.,!?;:"()[]{{}}')), lambda x: length(x) >= 3 AND {_SYLLABLES.format(w="x")} >= 3) AS h FROM documents)
SELECT doc_id, CAST(len(h) AS INTEGER) AS difficult_words, CAST(len(list_distinct(list_transform(w, lambda x: lower(x)))) AS INTEGER) AS unique_words, CASE WHEN len(w) < 50 THEN 'Low' ELSE 'High' END AS confidence FROM d""")
def difficult_and_unique_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.quality(_table(spark, sf_dir, "documents")).select("doc_id", "difficult_words", "unique_words", "confidence")


@_query(f"SELECT doc_id, len(w) AS words, CASE WHEN len(w) <= 100 THEN 'critical' ELSE 'warning' END AS severity FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) < 300")
def thin_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(tx.words(F.col("text"))).cast("long")
    return _table(spark, sf_dir, "documents").select("doc_id", n.alias("words")).filter("words < 300").withColumn("severity", F.when(F.col("words") <= 100, "critical").otherwise("warning"))


@_query("SELECT md5(text) AS hash, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY ALL HAVING count(*) > 1")
def text_hash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")).filter("copies > 1")


# -- measurements --------------------------------------------------------------------------------------------------------


@_query(f"""WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS count, {_sql_r('avg(value)')} AS avg, {_sql_r('median(value)')} AS median, {_sql_r('CASE WHEN count(*) > 1 THEN stddev_samp(value) ELSE 0 END', 3)} AS stddev, min(value) AS min, max(value) AS max, max(value) FILTER (WHERE i = floor(n * 0.9)) AS p90 FROM e GROUP BY event_type""")
def perf_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven numbers of event values by type."""
    found = statistics.statistics(_table(spark, sf_dir, "events"), "value", ("event_type",))
    return found.select("event_type", "count", _r("avg").alias("avg"), _r("median").alias("median"), _r("stddev", 3).alias("stddev"), "min", "max", "p90")


@_query("SELECT event_type, CASE WHEN value * 100 <= 2500 THEN 'good' WHEN value * 100 <= 4000 THEN 'needs-improvement' ELSE 'poor' END AS status, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL")
def cwv_status_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values times 100 stand for milliseconds."""
    status = vitals.band(F.col("value") * 100, 2500, 4000)
    return _table(spark, sf_dir, "events").filter("value is not null").groupBy("event_type", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@_query("""SELECT o_orderpriority, CASE WHEN s >= 90 THEN 'good' WHEN s >= 50 THEN 'needs-improvement' ELSE 'poor' END AS category, n FROM
(SELECT o_orderpriority, floor(avg(floor(o_totalprice)) * 1000 + 0.5) / 1000 / 4000 AS s, count(*) AS n FROM orders GROUP BY o_orderpriority)""")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order prices stand for scores."""
    found = _table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg((_r(F.avg(F.floor("o_totalprice")), 3) / 4000).alias("s"), F.count(F.lit(1)).alias("n"))
    return found.select("o_orderpriority", vitals.score_category(F.col("s")).alias("category"), "n")


_LAB = """
l AS (SELECT l_orderkey AS k, floor(sum(floor(l_extendedprice))) / 100 AS lab FROM lineitem GROUP BY l_orderkey),
b AS (SELECT k, lab, o_totalprice / 100 AS field, (lab - o_totalprice / 100) / (o_totalprice / 100) * 100 AS gap FROM l JOIN orders ON o_orderkey = k WHERE o_totalprice > 0)
"""


@_query(f"WITH {_LAB} SELECT count(*) AS pages, count(*) FILTER (WHERE gap < -20) AS lab_better, count(*) FILTER (WHERE gap > 20) AS field_better, count(*) FILTER (WHERE gap BETWEEN -20 AND 20) AS match, CASE WHEN count(*) FILTER (WHERE gap < -20) > count(*) FILTER (WHERE gap > 20) * 1.5 THEN 'optimistic' WHEN count(*) FILTER (WHERE gap > 20) > count(*) FILTER (WHERE gap < -20) * 1.5 THEN 'pessimistic' ELSE 'neutral' END AS tendency FROM b")
def lab_field_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of line prices stand for laboratory values, order totals for field values."""
    lab = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("url")).agg((F.floor(F.sum(F.floor("l_extendedprice"))) / 100).alias("lighthouse_lcp"))
    both = lab.join(_table(spark, sf_dir, "orders").filter("o_totalprice > 0").select(F.col("o_orderkey").alias("url"), (F.col("o_totalprice") / 100).alias("crux_lcp_percentile"), F.lit(None).cast("string").alias("crux_lcp_category")), "url")
    return statistics.lab_field_summary(statistics.lab_field(both)).select("pages", "lab_better", "field_better", "match", "tendency")


def _console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of type error stand for console errors of their user's page; the text is type and properties."""
    errors = _table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id", "event_id", F.concat(F.when(F.col("event_id") % 3 == 0, "TypeError: ").when(F.col("event_id") % 3 == 1, "Failed to load ").otherwise("odd "), "props").alias("m"))
    listed = errors.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "m"))), lambda x: x["m"]).alias("console_errors"))
    everyone = _table(spark, sf_dir, "events").select("user_id").distinct()
    empty = F.array().cast("array<string>")
    return everyone.join(listed, "user_id", "left").select(F.col("user_id").alias("crawl_seq"), F.col("user_id").cast("string").alias("url"), F.coalesce("console_errors", empty).alias("console_errors"), empty.alias("console_warnings"))


_CONSOLE = "m AS (SELECT user_id, event_id, CASE event_id % 3 WHEN 0 THEN 'TypeError: ' WHEN 1 THEN 'Failed to load ' ELSE 'odd ' END || props AS m FROM events WHERE event_type = 'error')"


@_query(f"WITH {_CONSOLE} SELECT CASE WHEN m LIKE 'TypeError:%' THEN 'TypeError' WHEN contains(m, 'Failed to load') OR contains(m, '404') THEN 'ResourceError' ELSE 'Other' END AS type, count(*) AS errors FROM m GROUP BY ALL")
def console_error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.console_rows(_console(spark, sf_dir)).groupBy("type").agg(F.count(F.lit(1)).alias("errors"))


@_query(f"WITH {_CONSOLE}, o AS (SELECT m, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM m) SELECT m AS message, n FROM (SELECT m, count(*) AS n, min((user_id, pos)) AS f FROM o GROUP BY m) ORDER BY n DESC, f LIMIT 10")
def top_error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent messages."""
    return site.common_messages(site.console_rows(_console(spark, sf_dir)))


@_query(f"""WITH {_CONSOLE}, s AS (SELECT (SELECT count(DISTINCT user_id) FROM events) AS pages, count(*) AS errors, count(DISTINCT user_id) AS pages_with_errors FROM m)
SELECT pages, errors, pages_with_errors, CASE WHEN errors = 0 THEN 'good' WHEN errors / pages > 0.5 THEN 'critical' WHEN errors / pages > 0.2 THEN 'high' WHEN errors / pages > 0.1 THEN 'medium' ELSE 'low' END AS severity FROM s""")
def console_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.console_summary(_console(spark, sf_dir)).select("pages", "errors", "pages_with_errors", "severity")


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for pages, their lines' prices for bytes, and return flags for resource kinds."""
    price = F.floor(F.col("l_extendedprice") * 10)
    kind = lambda k: F.coalesce(F.sum(F.when(F.col("l_returnflag") == k, price)), F.lit(0))
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(kind("A").alias("html_bytes"), kind("N").alias("js_bytes"), kind("R").alias("css_bytes"), F.sum(F.floor(F.col("l_extendedprice") * 11)).alias("page_bytes"))
    zero = F.lit(0).cast("long")
    return rows.select(F.col("l_orderkey").alias("crawl_seq"), F.col("l_orderkey").cast("string").alias("url"), "html_bytes", "js_bytes", "css_bytes", zero.alias("image_bytes"), zero.alias("font_bytes"), "page_bytes")


_RES = """
x AS (SELECT l_orderkey AS k, coalesce(sum(floor(l_extendedprice * 10)) FILTER (WHERE l_returnflag = 'A'), 0) AS h, coalesce(sum(floor(l_extendedprice * 10)) FILTER (WHERE l_returnflag = 'N'), 0) AS j,
  coalesce(sum(floor(l_extendedprice * 10)) FILTER (WHERE l_returnflag = 'R'), 0) AS c, sum(floor(l_extendedprice * 11)) AS t FROM lineitem GROUP BY l_orderkey)
"""


@_query(f"""WITH {_RES} SELECT count(*) AS pages, CAST(sum(h) AS BIGINT) AS html_bytes, CAST(sum(j) AS BIGINT) AS js_bytes, CAST(sum(c) AS BIGINT) AS css_bytes, CAST(sum(greatest(0, t - h - j - c)) AS BIGINT) AS other_bytes, CAST(sum(t) AS BIGINT) AS total_bytes,
count(*) FILTER (WHERE t > 2097152) AS bloated, count(*) FILTER (WHERE j > 512000) AS heavy_js, count(*) FILTER (WHERE c > 204800) AS heavy_css, CAST(floor(sum(t) / count(*)) AS BIGINT) AS avg_bytes, {_sql_r('sum(h) * 100.0::DOUBLE / sum(t)')} AS html_share FROM x""")
def resource_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = site.resource_summary(site.resource_rows(_resources(spark, sf_dir)))
    return found.select("pages", "html_bytes", "js_bytes", "css_bytes", "other_bytes", "total_bytes", "bloated", "heavy_js", "heavy_css", "avg_bytes", _r("html_share").alias("html_share"))


@_query(f"WITH {_RES} SELECT CAST(k AS VARCHAR) AS url, CAST(t AS BIGINT) AS total_bytes FROM x ORDER BY t DESC, k LIMIT 10")
def heaviest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten heaviest pages."""
    return site.heaviest(site.resource_rows(_resources(spark, sf_dir))).select("url", "total_bytes")


@_query(f"WITH {_RES} SELECT CAST(k AS VARCHAR) AS url, CAST(t AS BIGINT) AS total_bytes, {_sql_r('t / 1048576.0::DOUBLE', 2)} AS megabytes FROM x WHERE t > 2097152")
def bloated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = site.resource_rows(_resources(spark, sf_dir)).filter("total_bytes > 2097152")
    return rows.select("url", "total_bytes", _r(F.col("total_bytes") / 1048576.0, 2).alias("megabytes"))


#: Rows of lineitem, a domain of a page each, for every slice of the pages whose domains are counted.
LINES_A_SLICE = 1_000_000


def _third_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for pages, the suppliers of their lines for third-party domains."""
    names = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.when(F.col("l_suppkey") % 7 == 0, ".ads.example.com").when(F.col("l_suppkey") % 7 == 1, ".hotjar.com").when(F.col("l_suppkey") % 7 == 2, ".gstatic.com").otherwise(".example.co.uk"))
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("url")).agg(F.collect_set(names).alias("third_party_domains"), F.count(F.lit(1)).alias("third_party_requests"), F.sum(F.floor("l_extendedprice")).alias("third_party_bytes"), F.sum(F.floor(F.col("l_extendedprice") * 3)).alias("page_bytes"))


@_query("""SELECT domain, count(DISTINCT l_orderkey) AS requests, count(DISTINCT l_orderkey) AS pages, CASE WHEN k = 0 THEN 'advertising' WHEN k = 1 THEN 'analytics' WHEN k = 2 THEN 'cdn' ELSE 'other' END AS category FROM
(SELECT l_orderkey, l_suppkey % 7 AS k, 's' || l_suppkey || CASE l_suppkey % 7 WHEN 0 THEN '.ads.example.com' WHEN 1 THEN '.hotjar.com' WHEN 2 THEN '.gstatic.com' ELSE '.example.co.uk' END AS domain FROM lineitem) GROUP BY domain, k""")
def third_party_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").count()
    return site.third_party_domains(_third_parties(spark, sf_dir), slices=max(1, math.ceil(lines / LINES_A_SLICE)))


@_query(f"""WITH x AS (SELECT l_orderkey, count(*) AS n, sum(floor(l_extendedprice)) AS b, sum(floor(l_extendedprice * 3)) AS t FROM lineitem GROUP BY l_orderkey)
SELECT count(*) AS pages, count(*) AS with_third_party, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(b) AS BIGINT) AS bytes, {_sql_r('sum(n) / count(*)')} AS avg_requests, {_sql_r('sum(b) * 100.0::DOUBLE / sum(t)')} AS share FROM x""")
def third_party_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.third_party_summary(_third_parties(spark, sf_dir)).withColumns({"avg_requests": _r("avg_requests"), "share": _r("share")})


def _redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for redirected pages, their lines for hops."""
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")).alias("redirect_chain")).select(
        F.col("l_orderkey").alias("crawl_seq"), F.col("l_orderkey").cast("string").alias("url"), "redirect_chain", F.element_at("redirect_chain", -1).alias("final_url"), F.lit(True).alias("was_redirected")
    )


@_query(f"""WITH x AS (SELECT l_orderkey, count(*) AS h FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS chains, count(*) FILTER (WHERE h = 1) AS one, count(*) FILTER (WHERE h = 2) AS two, count(*) FILTER (WHERE h >= 3) AS three_plus,
CAST(sum(h) AS BIGINT) AS hops, {_sql_r('avg(h)')} AS avg_hops, CAST(max(h) AS INTEGER) AS longest, CAST(sum(h * 100) AS BIGINT) AS ms FROM x""")
def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.redirect_summary(site.redirect_rows(_redirects(spark, sf_dir))).withColumn("avg_hops", _r("avg_hops"))


@_query("SELECT CAST(l_orderkey AS VARCHAR) AS url, CAST(count(*) AS INTEGER) AS hops FROM lineitem GROUP BY l_orderkey ORDER BY count(*) DESC, l_orderkey LIMIT 50")
def longest_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty longest chains."""
    return site.longest_chains(site.redirect_rows(_redirects(spark, sf_dir))).select("url", "hops")


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for pages, their lines for images: part numbers name the format, discounts the alt text."""
    fmt = F.element_at(F.array(*[F.lit(x) for x in (".jpg", ".PNG?v=1", ".webp", "/avif", "")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    entry = F.map_from_arrays(F.when(F.col("l_suppkey") % 2 == 0, F.array(F.lit("src"), F.lit("alt"), F.lit("width"))).otherwise(F.array(F.lit("src"), F.lit("alt"))), F.when(F.col("l_suppkey") % 2 == 0, F.array(F.concat(F.lit("i"), fmt), F.when(F.col("l_discount") > 0.05, "a").otherwise(""), F.lit(""))).otherwise(F.array(F.concat(F.lit("i"), fmt), F.when(F.col("l_discount") > 0.05, "a").otherwise(""))))
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("url")).agg(F.collect_list(entry).alias("images"), F.count_if(F.col("l_tax") > 0.04).alias("lazy_images"), F.count_if(~(F.col("l_tax") > 0.04)).alias("eager_images"), F.sum(F.floor("l_extendedprice")).alias("image_bytes"))


@_query(f"""WITH i AS (SELECT count(*) AS images, count(*) FILTER (WHERE l_discount > 0.05) AS with_alt, count(*) FILTER (WHERE l_suppkey % 2 = 1) AS without_dimensions, count(*) FILTER (WHERE l_partkey % 5 IN (2, 3)) AS modern, count(*) FILTER (WHERE l_partkey % 5 IN (0, 1)) AS convertible,
count(*) FILTER (WHERE l_tax > 0.04) AS lazy, count(*) FILTER (WHERE NOT l_tax > 0.04) AS eager, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS bytes FROM lineitem),
s AS (SELECT CAST(sum(greatest(0, e - 3)) AS BIGINT) AS should_be_lazy FROM (SELECT count(*) FILTER (WHERE NOT l_tax > 0.04) AS e FROM lineitem GROUP BY l_orderkey))
SELECT images, with_alt, without_dimensions, modern, convertible, lazy, eager, bytes, should_be_lazy, {_sql_r('with_alt * 100.0::DOUBLE / images')} AS alt_share, CAST(floor(floor(bytes * (convertible / images)) * 0.3::DOUBLE) AS BIGINT) AS saving FROM i, s""")
def image_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = site.image_summary(_images(spark, sf_dir))
    return found.select("images", "with_alt", "without_dimensions", "modern", "convertible", "lazy", "eager", "bytes", "should_be_lazy", _r("alt_share").alias("alt_share"), "saving")


@_query("SELECT CASE l_partkey % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' WHEN 3 THEN 'avif' ELSE 'unknown' END AS format, count(*) AS images FROM lineitem GROUP BY ALL")
def image_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.image_formats(_images(spark, sf_dir))


# -- joins -----------------------------------------------------------------------------------------------------------------


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def psi_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand for pages, labels for their measurements."""
    return measurements.unmeasured(_table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels"), "doc_id")


@_query("SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN -1 ELSE l.quality END AS quality, l.toxic, (CASE WHEN d.doc_id % 2 <> 0 AND l.quality IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN l.toxic IS NOT NULL THEN 1 ELSE 0 END) AS filled FROM documents d LEFT JOIN labels l USING (doc_id)")
def psi_sync_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty cells of documents are filled from labels."""
    entries = _table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, -1).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    return measurements.fill_missing(entries, _table(spark, sf_dir, "labels"), "doc_id", ("quality", "toxic"))


@_query(f"""WITH x AS (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)), s AS (SELECT count(*) AS pages, count(quality) AS sampled, count(*) FILTER (WHERE quality = 1) AS succeeded FROM x)
SELECT pages, sampled, succeeded, sampled - succeeded AS failed, pages - sampled AS skipped, {_sql_r('succeeded * 100.0::DOUBLE / sampled')} AS share, succeeded * 100.0 / sampled >= 90 AS enough FROM s""")
def psi_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measurements.coverage(_table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("ok")), "doc_id")
    return found.withColumn("share", _r("share"))


@_query("""WITH a AS (SELECT DISTINCT user_id AS url FROM events WHERE ts < TIMESTAMP '2024-01-02'), b AS (SELECT DISTINCT user_id AS url FROM events WHERE ts >= TIMESTAMP '2024-01-30')
SELECT coalesce(a.url, b.url) AS url, CASE WHEN a.url IS NULL THEN 'added' WHEN b.url IS NULL THEN 'removed' ELSE 'kept' END AS change FROM a FULL JOIN b USING (url)""")
def crawl_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users of the first and last days stand for the URLs of two crawls."""
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("url"), "ts")
    return links.compare_crawls(e.filter("ts < timestamp_ntz'2024-01-02'"), e.filter("ts >= timestamp_ntz'2024-01-30'"))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily event counts by type stand for snapshots of domains."""
    return _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("domain"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("crawl_date")).agg(F.count(F.lit(1)).alias("total_pages"))


@_query("""WITH s AS (SELECT event_type AS domain, date_trunc('day', ts)::TIMESTAMP AS crawl_date, count(*) AS total_pages FROM events GROUP BY ALL)
SELECT domain, crawl_date, total_pages, total_pages - lag(total_pages) OVER (PARTITION BY domain ORDER BY crawl_date) AS total_pages_change FROM s""")
def snapshot_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import archives

    return archives.trend(_snapshots(spark, sf_dir), ("total_pages",))


@_query("SELECT event_type AS domain, max(date_trunc('day', ts)::TIMESTAMP) AS crawl_date FROM events GROUP BY ALL")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir).groupBy("domain").agg(F.max("crawl_date").alias("crawl_date"))


# -- requests, selectors, evidence -------------------------------------------------------------------------------------------


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for requests: users for domains, values for seconds, errors for failures."""
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("domain"), "ts", F.col("event_id").alias("seq"), F.floor(F.col("value") / 10).cast("double").alias("response_time"), (F.col("event_type") != "error").alias("success"))


_LOG = "g AS (SELECT user_id AS domain, ts, event_id AS seq, floor(value / 10)::DOUBLE AS response_time, event_type <> 'error' AS success FROM events)"


@_query(f"""WITH {_LOG} SELECT domain, seq, count(*) OVER w AS window_rows, {_sql_r('avg(response_time) OVER w')} AS avg_response, {_sql_r('(sum(CASE WHEN success THEN 0.0 ELSE 1.0 END) OVER w) / (count(*) OVER w)')} AS error_rate
FROM g WINDOW w AS (PARTITION BY domain ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def rolling_request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.rolling_metrics(_log(spark, sf_dir)).select("domain", "seq", "window_rows", _r("avg_response").alias("avg_response"), _r("error_rate").alias("error_rate"))


@_query(f"""WITH RECURSIVE {_LOG}, m AS (SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY ts, seq) AS i, seq, count(*) OVER w AS n, avg(response_time) OVER w AS a, (sum(CASE WHEN success THEN 0 ELSE 1 END) OVER w) / (count(*) OVER w) AS e
FROM g WINDOW w AS (PARTITION BY domain ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
r AS (SELECT domain, 0::BIGINT AS i, -1::BIGINT AS seq, 2.0::DOUBLE AS delay FROM (SELECT DISTINCT domain FROM m) UNION ALL
SELECT m.domain, m.i, m.seq, CASE WHEN m.n < 3 THEN r.delay ELSE greatest(0.5, least(10.0, CASE WHEN m.e > 0.1 THEN r.delay * 2 WHEN m.a > 2 THEN r.delay * least(m.a / 2, 2.0) WHEN m.e = 0 AND m.a < 1 THEN r.delay * 0.9 ELSE r.delay END)) END FROM r JOIN m ON m.domain = r.domain AND m.i = r.i + 1)
SELECT domain, seq, {_sql_r('delay')} AS delay FROM r WHERE i > 0""")
def adaptive_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.adaptive_delay(_log(spark, sf_dir)).select("domain", "seq", _r("delay").alias("delay"))


@_query(f"""WITH {_LOG}, u AS (SELECT *, count(*) OVER w AS n, sum(CASE WHEN success THEN 0 ELSE 1 END) OVER w AS bad FROM g WINDOW w AS (PARTITION BY domain ORDER BY seq)),
s AS (SELECT *, CASE WHEN NOT success AND bad / n > 0.5 THEN 'unhealthy' WHEN NOT success AND bad / n > 0.2 THEN 'degraded' END AS state FROM u)
SELECT domain, seq, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY domain ORDER BY seq), 'healthy') AS health FROM s""")
def context_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.context_health(_log(spark, sf_dir), by="domain").select("domain", "seq", "health")


@_query(f"""WITH {_LOG} SELECT domain, count(*) AS uses, {_sql_r('avg(CASE WHEN success THEN 1.0 ELSE 0.0 END)')} AS success_rate, {_sql_r('avg(response_time * 1000) FILTER (WHERE success)')} AS avg_ms FROM g GROUP BY domain""")
def proxy_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.use_statistics(_log(spark, sf_dir), "domain").select("domain", "uses", _r("success_rate").alias("success_rate"), _r("avg_ms").alias("avg_ms"))


@_query(f"""WITH {_LOG}, t AS (SELECT domain, seq, row_number() OVER w AS n, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY domain)) / 1000000 / 3600 AS t FROM g WINDOW w AS (PARTITION BY domain ORDER BY ts, seq))
SELECT domain, seq, {_sql_r('greatest(0.0, (n - min(n - 1 - t * 0.05::DOUBLE) OVER (PARTITION BY domain ORDER BY n) - 3) / 0.05::DOUBLE - t)', 2)} AS wait FROM t""")
def token_bucket_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token every 20 hours, three at most."""
    rate = 0.05 / 3600
    return requests.token_bucket(_log(spark, sf_dir), rate, 3).select("domain", "seq", _r(F.col("wait") / 3600, 2).alias("wait"))


def _selector_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for selector uses: users for sites, types for purposes."""
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("site"), F.col("event_type").alias("purpose"), F.lit("#x").alias("selector"), "ts", (F.col("event_id") % 4 != 0).alias("success"))


_SEL = """s AS (SELECT user_id AS site, event_type AS purpose, count(*) FILTER (WHERE event_id % 4 <> 0) AS good, count(*) FILTER (WHERE event_id % 4 = 0) AS bad, max(ts) FILTER (WHERE event_id % 4 <> 0) AS lg, max(ts) FILTER (WHERE event_id % 4 = 0) AS lb, max(ts) AS lu FROM events GROUP BY ALL),
c AS (SELECT *, (good + 2) / (good + bad + 3) * CASE WHEN lb > lg THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM s)"""


@_query(f"WITH {_SEL} SELECT site, purpose, good AS success, bad AS failure, {_sql_r('confidence')} AS confidence, {_sql_r('0.5::DOUBLE * (1 - least(1.0::DOUBLE, (good + bad) / 20.0::DOUBLE)) + confidence * least(1.0::DOUBLE, (good + bad) / 20.0::DOUBLE)')} AS reliability FROM c")
def selector_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.from_events(_selector_events(spark, sf_dir)).select("site", "purpose", "success", "failure", _r("confidence").alias("confidence"), _r("reliability").alias("reliability"))


@_query(f"""WITH {_SEL}, l AS (SELECT *, floor(epoch(TIMESTAMP '2024-03-30' - lu) / 86400) AS days FROM c)
SELECT count(*) AS selectors, count(*) FILTER (WHERE days >= 30 AND days < 90) AS stale, count(*) FILTER (WHERE days >= 90) AS expired, count(*) FILTER (WHERE confidence < 0.5) AS low, count(DISTINCT site) AS sites FROM l""")
def selector_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.lifecycle_report(selectors.from_events(_selector_events(spark, sf_dir)), "2024-03-30 00:00:00").select("selectors", "stale", "expired", "low", "sites")


@_query("SELECT event_id FROM events WHERE ts + INTERVAL 24 HOURS >= TIMESTAMP '2024-01-20'")
def ttl_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of 24 hours that have not expired on 20 January."""
    entries = _table(spark, sf_dir, "events").select("event_id", (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"))
    return requests.not_expired(entries.withColumn("expires_at", F.col("expires_at").cast("timestamp")), datetime(2024, 1, 20)).select("event_id")


@_query("SELECT event_type AS finding, count(*) AS records, CASE WHEN bool_or(value > 45) THEN 'Medium' WHEN bool_or(event_id % 5 = 0) THEN 'High' ELSE 'Medium' END AS confidence FROM events GROUP BY event_type")
def evidence_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for evidence: large values for model output, every fifth for High."""
    rows = _table(spark, sf_dir, "events").select(F.col("event_type").alias("finding"), (F.col("value") > 45).alias("ai_generated"), F.when(F.col("event_id") % 5 == 0, "High").otherwise("Medium").alias("confidence"))
    return evidence.combined_confidence(rows, ("finding",))


@_query("SELECT doc_id AS id, 'do ' || doc_id AS action, (doc_id % 10 + 1)::DOUBLE AS impact, (doc_id % 9 + 1)::DOUBLE AS ease, doc_id % 8 + 0.5::DOUBLE AS ice, CASE WHEN doc_id % 8 + 0.5 >= 6 THEN 'critical' WHEN doc_id % 8 + 0.5 >= 4 THEN 'high' WHEN doc_id % 8 + 0.5 >= 2 THEN 'medium' ELSE 'low' END AS tier, doc_id % 9 + 1 >= 7 AND doc_id % 10 + 1 >= 7 AS quick_win FROM documents")
def ice_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendation lines written from document numbers."""
    d = F.col("doc_id")
    s = lambda c: c.cast("string")
    response = F.concat(F.lit("- [I:"), s(d % 10 + 1), F.lit(" C:"), s(d % 7 + 1), F.lit(" E:"), s(d % 9 + 1), F.lit(" = ICE:"), s(d % 8), F.lit(".5] do "), s(d), F.lit("\nmore"))
    rows = _table(spark, sf_dir, "documents").select(d.alias("id"), response.alias("response"))
    return advice.scored_lines(rows).select("id", "action", "impact", "ease", "ice", "tier", "quick_win")


@_query("SELECT doc_id AS id, 'count' AS kind, (doc_id % 5)::DOUBLE AS claimed, 3.0::DOUBLE AS actual, 'missing_titles' AS metric, doc_id % 5 = 3 AS holds FROM documents")
def claim_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims written from document numbers against one metric."""
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat((F.col("doc_id") % 5).cast("string"), F.lit(" pages with a missing title. Done")).alias("response"))
    metrics = spark.createDataFrame([("missing_titles", 3)], "metric string, pages long")
    return advice.check_claims(rows, metrics, 100)


@_query("SELECT s_name AS domain, 1 AS has_robots, s_suppkey % 3 = 0 AS has_sitemap FROM supplier")
def robots_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """robots.txt files written from supplier numbers."""
    text = F.concat(F.lit("User-agent: *\nDisallow: /x\n"), F.when(F.col("s_suppkey") % 3 == 0, "Sitemap: https://e/s.xml").otherwise(""))
    found = site_files.sitemap_candidates(site_files.robots_analysis(_table(spark, sf_dir, "supplier").select(F.col("s_name").alias("domain"), text.alias("content"))))
    return found.select("domain", F.col("has_robots").cast("int").alias("has_robots"), "has_sitemap")
