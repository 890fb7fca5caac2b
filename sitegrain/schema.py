"""The page table.

One row a page.  ``crawl_seq`` keeps crawl order, on which ties and first-N samples rest.  Images, links and the like
are arrays; child tables come from exploding one of them at a time.
"""

from __future__ import annotations

from pyspark.sql import types as T

_IMAGE = "images"
_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "strings": T.ArrayType(T.StringType()),
    "flags": T.MapType(T.StringType(), T.BooleanType()),
    "properties": T.MapType(T.StringType(), T.StringType()),
    "images": T.ArrayType(T.MapType(T.StringType(), T.StringType())),
    "alternates": T.ArrayType(T.StructType([T.StructField("hreflang", T.StringType()), T.StructField("href", T.StringType())])),
}


def _table(columns: str) -> T.StructType:
    """A table from ``name type`` pairs; no session is needed for it."""
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in (c.split() for c in columns.split(","))])


#: What the HTML extractor yields for a page.
EXTRACTED = _table(
    f"""
    title string, description string, keywords strings, h1_tags strings, h2_tags strings,
    images {_IMAGE}, total_images bigint, images_without_alt bigint, lazy_images bigint, eager_images bigint,
    links strings, hrefs strings, internal_links bigint, external_links bigint,
    content_text string, word_count bigint, canonical_url string, robots_directives flags,
    json_ld strings, json_ld_errors bigint, open_graph properties, twitter_card properties,
    viewport string, lang string, hreflang alternates, charset string,
    buttons_without_aria bigint, links_without_context bigint, inputs_without_labels bigint,
    lcp_candidates bigint, blocking_scripts bigint, cls_risks bigint, render_blocking bigint, lazy_opportunities bigint,
    schema_types strings, microdata_count bigint, rdfa_count bigint, schema_errors strings, schema_warnings strings,
    page_types strings, script_sources strings, link_sources strings, generator string,
    html_bytes bigint, text_ratio double, content_hash string
    """
)

#: What a crawl knows about a page besides its HTML.
CRAWLED = _table(
    """
    crawl_seq bigint, url string, status_code int, load_time double, headers properties, final_url string,
    was_redirected boolean, redirect_chain strings, console_errors strings, console_warnings strings,
    css_bytes bigint, js_bytes bigint, image_bytes bigint, font_bytes bigint, page_bytes bigint,
    third_party_domains strings, third_party_requests bigint, third_party_bytes bigint,
    technologies strings, success boolean, error string
    """
)

#: What laboratory and field measurements add.
MEASURED = _table(
    """
    lighthouse_performance double, lighthouse_accessibility double, lighthouse_best_practices double, lighthouse_seo double,
    lighthouse_pwa double, lighthouse_fcp double, lighthouse_lcp double, lighthouse_si double, lighthouse_tti double,
    lighthouse_tbt double, lighthouse_cls double,
    crux_lcp_percentile double, crux_lcp_category string, crux_fid_percentile double, crux_cls_percentile double,
    crux_overall_category string
    """
)

PAGE = T.StructType([*CRAWLED.fields, *EXTRACTED.fields, *MEASURED.fields])

#: One metrics row a crawl.
SNAPSHOT_METRICS = (
    "total_pages pages_with_issues technical_issues missing_titles duplicate_titles missing_descriptions missing_h1 multiple_h1 images_without_alt "
    "slow_pages thin_pages missing_canonical broken_links orphan_pages"
).split()
SNAPSHOT = _table("domain string, crawl_date timestamp_ntz, avg_load_time double, technical_score double, " + ", ".join(f"{m} bigint" for m in SNAPSHOT_METRICS))


def missing(table: T.StructType, columns: list[str]) -> list[T.StructField]:
    """The fields of ``table`` that ``columns`` lacks."""
    return [f for f in table.fields if f.name not in columns]
