"""A furnished page table: every page of ``pages`` with markup, headers and measurements that vary by its number.

The raw pages have no images, descriptions, canonical links, structured data, social properties or headers, so most
operators could only give one answer on them.  :func:`furnished` writes such markup around every page's url, by
arithmetic on its number alone, and oracles follow the same arithmetic in SQL without reading any HTML.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import html

OG = ("og:title", "og:description", "og:image", "og:url", "og:type", "og:site_name", "og:locale")
TWITTER = ("twitter:card", "twitter:title", "twitter:description", "twitter:image", "twitter:site")

#: What a page is given, in SQL that both engines read.
FACTS = """
SELECT page_id, url,
  CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'A title that several pages have in common' WHEN 2 THEN repeat('t', 70) ELSE 'Page ' || page_id END AS title,
  CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN repeat('d', 60) WHEN 2 THEN repeat('word ', 27) || 'x' ELSE repeat('long ', 40) || 'y' END AS description,
  CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN url ELSE 'https://other.example/c' END AS canonical,
  CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'width=device-width, initial-scale=1' WHEN 2 THEN 'width=980' WHEN 3 THEN 'initial-scale=1' ELSE 'width=device-width' END AS viewport,
  CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'noindex, follow' WHEN 2 THEN 'NOFOLLOW,noarchive' ELSE 'index' END AS robots,
  CASE page_id % 3 WHEN 0 THEN '' ELSE 'en' END AS lang,
  CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'utf-8' WHEN 2 THEN 'ISO-8859-1' ELSE 'UTF-8' END AS charset,
  page_id % 3 AS n_h1, page_id % 4 AS n_h2, page_id % 13 AS n_images, (page_id % 7) * 60 AS n_words,
  page_id % 4 AS n_buttons, page_id % 5 AS n_anchors, page_id % 3 AS n_inputs, page_id % 4 AS n_scripts,
  page_id % 8 AS schema_kind, page_id % 5 AS section, page_id % 8 AS n_og, page_id % 6 AS n_twitter,
  CASE WHEN page_id % 4 = 0 THEN 'banner' ELSE 'summary' END AS card, page_id % 4 AS alternates,
  CASE WHEN page_id % 9 = 0 THEN NULL ELSE (page_id % 9) * 0.75 END AS load_time, page_id % 4 AS n_errors, page_id % 3 AS n_warnings,
  page_id % 101 AS performance, page_id % 7 AS hops
FROM pages
"""

#: Structured data by kind.
BLOCKS = {
    1: '<script type="application/ld+json">{"@type":"Product","name":"x"}</script>',
    2: '<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"Organization","name":"o"},{"@type":["Article","Thing"],"headline":"h"}]}</script>',
    3: '<script type="application/ld+json">{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"q"}]}</script>',
    4: '<script type="application/ld+json">{"@type": </script>',
    5: '<div itemscope itemtype="https://schema.org/Recipe"></div>',
    6: '<div typeof="Event Place"></div>',
    7: '<script type="application/ld+json">{"@type":"BreadcrumbList"}</script>',
}
#: Sections of a body that tell what kind of page it is.
SECTIONS = {0: '<div class="price"></div>', 1: '<iframe src="https://www.youtube.com/embed/x" width="1" height="1"></iframe>', 2: "<article></article>"}


def _several(n: str, body: str) -> str:
    return f"CASE WHEN {n} > 0 THEN array_join(transform(sequence(0, cast({n} as int) - 1), i -> {body}), '') ELSE '' END"


def _case(value: str, texts: dict[int, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in texts.items()) + " ELSE '' END"


def _properties(names: tuple[str, ...], attribute: str, n: str, content: str) -> str:
    listed = ", ".join(f"'{x}'" for x in names)
    return f"array_join(transform(slice(array({listed}), 1, cast({n} as int)), x -> '<meta {attribute}=\"' || x || '\" content=\"' || {content} || '\">'), '')"


_HTML = " || ".join(
    [
        "'<!DOCTYPE html><html' || CASE WHEN lang = '' THEN '' ELSE ' lang=\"' || lang || '\"' END || '><head><title>' || title || '</title>'",
        "CASE page_id % 4 WHEN 0 THEN '' WHEN 3 THEN '<meta http-equiv=\"Content-Type\" content=\"text/html; charset=UTF-8\">' ELSE '<meta charset=\"' || charset || '\">' END",
        "CASE WHEN description = '' THEN '' ELSE '<meta name=\"description\" content=\"' || description || '\">' END",
        "'<meta name=\"keywords\" content=\"a, k' || page_id % 3 || '\">'",
        "CASE WHEN viewport = '' THEN '' ELSE '<meta name=\"viewport\" content=\"' || viewport || '\">' END",
        "CASE WHEN robots = '' THEN '' ELSE '<meta name=\"robots\" content=\"' || robots || '\">' END",
        "CASE WHEN canonical = '' THEN '' ELSE '<link rel=\"canonical\" href=\"' || canonical || '\">' END",
        "CASE alternates WHEN 1 THEN '<link rel=\"alternate\" hreflang=\"en\" href=\"' || url || '\">' WHEN 2 THEN '<link rel=\"alternate\" hreflang=\"xx\" href=\"https://other.example/\"><link rel=\"alternate\" hreflang=\"en-GB\" href=\"' || url || '/\">' WHEN 3 THEN '<link rel=\"alternate\" hreflang=\"x-default\" href=\"https://other.example/\">' ELSE '' END",
        _properties(OG, "property", "n_og", "'v'"),
        _properties(TWITTER, "name", "n_twitter", "CASE x WHEN 'twitter:card' THEN card ELSE 'v' END"),
        "'<link rel=\"stylesheet\" href=\"/s.css\">'",
        _several("n_scripts", "'<script src=\"/s' || i || '.js\"' || CASE i WHEN 1 THEN ' async=\"async\"' WHEN 2 THEN ' defer=\"defer\"' ELSE '' END || '></script>'"),
        "'</head><body>'",
        _several("n_h1", "'<h1>Head</h1>'"),
        _several("n_h2", "'<h2>Second</h2>'"),
        "'<p>' || repeat('word ', cast(n_words as int)) || '</p>'",
        _several("n_images", "'<img src=\"/img/' || i || CASE (page_id + i) % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.webp' WHEN 3 THEN '.svg?v=1' ELSE '?f=avif' END || '\"' || CASE WHEN i % 3 <> 0 THEN ' alt=\"a\"' WHEN i % 2 = 0 THEN ' alt=\"\"' ELSE '' END || CASE WHEN i % 4 = 3 THEN ' loading=\"lazy\"' ELSE '' END || CASE WHEN i % 2 = 0 THEN ' width=\"1\" height=\"1\"' ELSE '' END || '>'"),
        _several("n_buttons", "'<button></button>'") + " || '<button aria-label=\"l\"></button>'",
        _several("n_anchors", "'<a href=\"/x' || i || '\"></a>'") + " || '<a href=\"/t\" title=\"t\"></a>'",
        _several("n_inputs", "'<input name=\"q\">'") + " || '<input type=\"hidden\"><input id=\"z\">'",
        _case("schema_kind", BLOCKS),
        _case("section", SECTIONS),
        "'</body></html>'",
    ]
)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every page is given."""
    columns = FACTS.strip().removeprefix("SELECT").rsplit("FROM pages", 1)[0]
    return spark.sql(f"SELECT {columns} FROM {{pages}}", pages=spark.read.parquet(f"{sf_dir}/pages.parquet"))


def furnished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table of the furnished pages, headers, measurements, console and redirects included."""
    given = facts(spark, sf_dir)
    raw = given.select("page_id", "url", F.expr(_HTML).alias("html"))
    given = given.select(F.col("page_id").alias("_id"), F.col("load_time").cast("double").alias("_load"), "n_errors", "n_warnings", "performance", "hops")
    table = html.page_table(raw).join(given, F.col("crawl_seq") == F.col("_id"))
    headers = F.expr(
        """map_from_entries(array_compact(array(struct('Server' as key, 'nginx' as value), if(_id % 2 = 0, struct('Strict-Transport-Security' as key, 'x' as value), null),
        if(_id % 3 = 0, struct('Content-Security-Policy' as key, 'x' as value), null), if(_id % 5 = 0, struct('X-Content-Type-Options' as key, 'nosniff' as value), null), if(_id % 7 = 0, struct('x-frame-options' as key, 'DENY' as value), null))))"""
    )
    added = {
        "headers": headers,
        "load_time": F.col("_load"),
        "console_errors": F.expr("slice(array('TypeError: x is undefined', 'Failed to fetch /a', 'x is deprecated'), 1, cast(n_errors as int))"),
        "console_warnings": F.expr("slice(array('w', 'w'), 1, cast(n_warnings as int))"),
        "lighthouse_performance": F.col("performance").cast("double"),
        "was_redirected": F.col("hops") > 0,
        "redirect_chain": F.expr("if(hops > 0, transform(sequence(1, cast(hops as int)), i -> 'h' || i), array())"),
    }
    return table.withColumns(added).drop("_id", "_load", "n_errors", "n_warnings", "performance", "hops")
