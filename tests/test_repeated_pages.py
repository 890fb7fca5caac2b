"""Queries against their SQL where pages share a URL and titles end inside a character reference."""

import duckdb
import pytest

from sitegrain.plans import crawling, findings, proofs, slate  # noqa: F401  the others add to the slate

from test_oracles import sorted_rows

PAGES = [
    (0, "https://h.example/", ["/b", "/a", "/c"], "A title that is cut inside a reference, as it ends in &amp"),
    (1, "https://h.example/x", ["/z", "/a"], "Short &am"),
    (2, "https://h.example/y", [], "Twice &amp"),
    (3, "https://h.example/", ["/a", "/d", "/late", "/e?a=1&reg=2"], "Twice &amp"),
    (50, "https://h.example/x", ["/y", "/only"], "A title of thirty letters &amp"),
    (120, "https://h.example/x", ["/b"], "Marks &amp; signs &middot; &#65 and &quot;more&quot; in one line &quot"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("repeated"))
    html = "<html><head><title>{}</title></head><body><h1>H</h1><p>some words</p>{}</body></html>"
    rows = [(i, u, html.format(t, "".join(f'<a href="{h}">t</a>' for h in hrefs))) for i, u, hrefs, t in PAGES]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def sql(folder):
    connection = duckdb.connect()
    connection.sql("SET threads = 1")
    connection.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet') ORDER BY page_id")
    return lambda name: connection.sql(slate.ORACLES[name])


NAMES = [
    "duplicate_titles", "evidence_by_finding", "page_facts", "prioritised_issues", "technical_issue_counts", "title_length_issues",
    "broken_internal_links", "crawl_visits", "crawl_visits_with_failures", "internal_external_counts", "pages_as_json", "sitemap_entries",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, folder, sql, name):
    found, expected = slate.QUERIES[name](spark, folder), sql(name)
    assert sorted_rows(found.columns, found.collect()) == sorted_rows(expected.columns, expected.fetchall())
