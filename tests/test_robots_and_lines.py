"""Robots rules against the standard library's parser, and texts of reports as lines."""

import random
from pathlib import Path
from urllib.robotparser import RobotFileParser

from sitegrain.operators import reports, selectors, sinks, site
from sitegrain.sources import site_files

PARTS = ["User-agent: *", "User-agent: Bot", "user-agent: other/2 # named", "Disallow: /a", "Disallow: /a/b", "Allow: /a/b", "Disallow:", "Disallow: /%7Ex", "Allow: /a b", "Crawl-delay: 3", "Request-rate: 1/5", "", "# note", "Sitemap: https://h/s.xml", "nonsense", "Disallow: *", " Allow : /q?x=1 "]
AGENTS = ["Bot", "bot/1.0", "a robot of mine", "other", "", "*", None]
URLS = ["https://h/a", "https://h/a/b/c", "http://h", "https://h/~x/1", "/a%20b", "https://h/q?x=1&y", "https://h/z", "https://h/a/+b", None]


def parsed(text):
    parser = RobotFileParser()
    parser.parse(text.splitlines())
    return parser


def test_rules_as_the_standard_library_reads_them(spark):
    rng = random.Random(7)
    files = {f"d{i}": rng.choice(["\n", "\r\n"]).join(rng.choices(PARTS[:3], k=i % 3) + rng.choices(PARTS, k=rng.randrange(0, 14))) for i in range(150)}
    known = {d: parsed(t) for d, t in files.items()}
    asked = [(d, a, u) for d in files for a in AGENTS for u in URLS]
    expected = {(d, a, u): not files[d] or known[d].can_fetch(a or "*", u or "") for d, a, u in asked}
    robots = spark.createDataFrame(list(files.items()), "domain string, content string")
    rows = site_files.fetch_decisions(spark.createDataFrame(asked, "domain string, agent string, url string"), robots).collect()
    got = {(r.domain, r.agent, r.url): r.allowed for r in rows}
    assert len(rows) == len(asked)
    assert {k: (files[k[0]], v) for k, v in got.items() if v != expected[k]} == {}
    assert 0.05 < sum(not v for v in expected.values()) / len(expected)


def test_requests_of_domains_without_a_file(spark):
    robots = spark.createDataFrame([("h", None), ("i", "User-agent: *\nDisallow: /")], "domain string, content string")
    asked = spark.createDataFrame([("h", "x", "/"), ("j", "x", "/"), (None, None, None), ("i", None, "/"), ("i", None, "/")], "domain string, agent string, url string").selectExpr("*", "1 AS place", "2 AS rules")
    got = site_files.fetch_decisions(asked, robots)
    assert got.columns == ["domain", "agent", "url", "place", "rules", "allowed"]
    assert sorted((r.domain or "", r.allowed) for r in got.collect()) == [("", True), ("h", True), ("i", False), ("i", False), ("j", True)]
    assert site_files.fetch_decisions(asked.limit(0), robots.limit(0)).count() == 0


def test_lines_are_written_in_order(spark, tmp_path):
    lines = spark.range(5000).selectExpr("CAST(4999 - id AS INT) AS place", "0 AS no", "CAST(4999 - id AS STRING) AS line").repartition(7)
    sinks.write_lines(str(tmp_path / "text"), lines)
    text = "".join(p.read_text() for p in sorted(Path(tmp_path / "text").glob("part-*")))
    assert text.split() == [str(i) for i in range(5000)]


def test_crawl_lines(spark):
    schema = "url string, crawl_seq long, title string, description string, h1_tags array<string>, word_count int, total_images int"
    rows = [("https://h/", 0, "T", "d", ["x"], 1200, 3), ("https://h/b", 1, None, "", [], 4, None)]
    got = [r.line for r in reports.crawl_lines(spark.createDataFrame(rows, schema), "https://h/").orderBy("section", "no").collect()]
    assert got[:3] == ["crawl of https://h/", "pages: 2", "words: 1,204"]
    assert got[-2:] == ["- https://h/", "- https://h/b [no title, no description, no h1, thin]"]
    empty = [r.line for r in reports.crawl_lines(spark.createDataFrame([], schema), "x").orderBy("section", "no").collect()]
    assert empty == ["crawl of x", "pages: 0"]


def test_profiles_of_many_patterns(spark):
    n = selectors.PATTERN_BLOCK * 3 + 5
    patterns = spark.createDataFrame([(f"https://h/{i}/", f"p{i}", i) for i in range(n)] + [("https://h/", "last", n)], "pattern string, profile string, pos int")
    pages = spark.createDataFrame([(f"https://h/{n - 1}/x",), ("https://h/3/y",), ("https://h/3/y",), ("https://h/none",), ("other",), (None,)], "url string")
    got = sorted((r.url or "", r.profile or "") for r in selectors.page_profiles(pages, patterns).collect())
    assert got == [("", ""), ("https://h/3/y", "p3"), ("https://h/3/y", "p3"), (f"https://h/{n - 1}/x", f"p{n - 1}"), ("https://h/none", "last"), ("other", "")]
    assert [r.profile for r in selectors.page_profiles(pages, patterns.limit(0)).collect()] == [None] * 6


def test_running_schema_over_slices(spark):
    rows = spark.range(3000).selectExpr("id AS crawl_seq", "CAST(id AS STRING) AS url", "CAST(array() AS array<string>) AS schema_types", "IF(id = 1700, 1, 0) AS json_ld", "IF(id = 2500, 2, 0) AS microdata_count").repartition(6)
    got = site.with_running_schema(rows)
    assert got.filter("counted").agg({"crawl_seq": "min"}).first()[0] == 1700 and got.filter("counted").count() == 1300
    assert got.columns == [*rows.columns, "counted"]
