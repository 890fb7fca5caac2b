"""Rollups, request logs, selectors, sources and streams on hand-computed frames."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from sitegrain.operators import advice, api, evidence, links, measurements, requests, selectors, site, statistics
from sitegrain.sources import archives, lighthouse, site_files, sitemaps
from sitegrain.streaming import requests as streams


def test_images(spark):
    rows = [
        ("/page1", [{"src": "image1.jpg", "alt": "Image 1"}, {"src": "image2.png", "alt": ""}, {"src": "image3.webp", "alt": "Image 3"}, {"src": "image4.jpg"}], 1, 3, 500000),
        ("/page2", [{"src": "hero.jpg", "alt": "Hero"}, {"src": "logo.png", "alt": "Logo", "width": "100", "height": ""}], 0, 2, 200000),
    ]
    pages = spark.createDataFrame(rows, "url string, images array<map<string,string>>, lazy_images long, eager_images long, image_bytes long")
    s = site.image_summary(pages).withColumn("rules", advice.image_rules()).first()
    assert (s.images, s.with_alt, s.without_dimensions, s.modern, s.convertible, s.bytes, s.saving, s.should_be_lazy) == (6, 4, 5, 1, 5, 700000, 174999, 0)
    assert s.alt_share == pytest.approx(66.67, abs=0.01) and s.rules == ["modern_formats", "dimensions", "alt_text"]
    assert {r.format: r.images for r in site.image_formats(pages).collect()} == {"jpg": 3, "png": 2, "webp": 1}
    none = site.image_summary(pages.limit(0)).first()
    assert (none.images, none.saving, none.alt_share) == (0, 0, 0.0)


def test_redirects(spark):
    rows = [(0, "/old", True, ["/old", "/new"], "/new"), (1, "/legacy", True, ["a", "b", "c"], ""), (2, "/direct", False, [], None), (3, "/odd", True, None, None)]
    pages = spark.createDataFrame(rows, "crawl_seq long, url string, was_redirected boolean, redirect_chain array<string>, final_url string")
    chains = site.redirect_rows(pages)
    s = site.redirect_summary(chains).withColumn("rules", advice.redirect_rules(F.lit(4))).first()
    assert (s.chains, s.hops, s.avg_hops, s.longest, s.one, s.two, s.three_plus, s.ms) == (2, 5, 2.5, 3, 0, 1, 1, 500) and s.rules == ["three_plus", "many_pages"]
    assert [r.final for r in site.longest_chains(chains).collect()] == ["/legacy", "/new"]
    assert site.redirect_summary(site.redirect_rows(pages.limit(0))).first().chains == 0


def test_console(spark):
    rows = [(0, "/a", ["TypeError: x", "odd"], ["w"]), (1, "/b", ["odd", "z" * 200], []), (2, "/c", [], []), (3, "/d", None, None)]
    pages = spark.createDataFrame(rows, "crawl_seq long, url string, console_errors array<string>, console_warnings array<string>")
    s = site.console_summary(pages).first()
    assert (s.errors, s.warnings, s.pages_with_errors, s.error_free, s.severity) == (4, 1, 2, 50.0, "critical")
    assert [(r.message, r.n) for r in site.common_messages(site.console_rows(pages)).collect()] == [("odd", 2), ("TypeError: x", 1), ("z" * 100, 1)]


def test_resources_and_third_parties(spark):
    rows = [(0, "/a", 100, 0, 600 * 1024, 0, 0, 3 * 1024 * 1024, ["x.hotjar.com", "cdn.example"], 9, 50), (1, "/b", 10, 20, 30, 40, 50, 0, [], 0, 0), (2, "/c", None, None, None, None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "crawl_seq long, url string, html_bytes long, css_bytes long, js_bytes long, image_bytes long, font_bytes long, page_bytes long, third_party_domains array<string>, third_party_requests long, third_party_bytes long")
    r = {x.url: x for x in site.resource_rows(pages).collect()}
    assert r["/b"].total_bytes == 150 and r["/a"].other_bytes == 3 * 1024 * 1024 - 600 * 1024 - 100 and r["/c"].total_bytes == 0
    s = site.resource_summary(site.resource_rows(pages)).withColumn("rules", advice.resource_rules()).first()
    assert (s.bloated, s.heavy_js, s.heavy_css) == (1, 1, 0) and "bloated" in s.rules and "heavy_js" in s.rules
    assert [x.url for x in site.heaviest(site.resource_rows(pages), 2).collect()] == ["/a", "/b"]
    assert {x.domain: (x.requests, x.category) for x in site.third_party_domains(pages).collect()} == {"x.hotjar.com": (1, "analytics"), "cdn.example": (1, "cdn")}
    t = site.third_party_summary(pages).withColumn("rules", advice.third_party_rules(F.lit(3), F.lit(0))).first()
    assert (t.with_third_party, t.requests, t.avg_requests) == (1, 9, 9.0) and t.rules == ["analytics"]


def test_social_headers_tree(spark):
    rows = [(0, "https://h/a/b", {"og:title": "t"}, {}, {"content-security-policy": "x"}), (1, "https://h/a", {}, {"twitter:card": "summary"}, {}), (2, "https://h/", None, None, None)]
    pages = spark.createDataFrame(rows, "crawl_seq long, url string, open_graph map<string,string>, twitter_card map<string,string>, headers map<string,string>")
    s = site.social_rows(pages)
    t = site.social_summary(s).first()
    assert t.og_coverage == pytest.approx(100 / 3) and (t.og_score, t.twitter_score) == (15.0, 25.0)
    assert site.missing_properties(s, 1).first().property == "og:description"
    assert {r.header: r.state for r in site.header_coverage(site.security_rows(pages)).collect()} == {"strict-transport-security": "none", "x-content-type-options": "none", "x-frame-options": "none", "content-security-policy": "partial"}
    assert {(r.prefix, r.type, r.pages) for r in site.site_tree(pages).collect()} == {("a", "directory", 2), ("a/b", "file", 1), ("(homepage)", "file", 1)}


def test_running_schema_and_challenges(spark):
    rows = spark.createDataFrame([(0, "a", [], 0, 0), (1, "b", [], 1, 0), (2, "c", [], 0, 0)], "crawl_seq long, url string, schema_types array<string>, json_ld int, microdata_count int")
    assert [r.counted for r in site.with_running_schema(rows).orderBy("url").collect()] == [False, True, True]
    c = spark.createDataFrame([("a", "v2", True), ("b", None, None), ("c", None, None), ("d", None, None), ("e", None, None)], "url string, challenge_version string, blocking boolean")
    s = site.challenge_summary(c).first()
    assert (s.challenged, s.blocking, s.rate, s.level) == (1, 1, 20.0, "medium")


def test_technology_coverage(spark):
    pages = spark.createDataFrame([(i, f"u{i}", ["React"] + (["Vue"] if i % 2 else [])) for i in range(12)], "crawl_seq long, url string, technologies array<string>")
    got = {r.technology: r for r in site.technology_coverage(pages).collect()}
    assert got["React"].pages == 12 and len(got["React"].examples) == 10 and got["React"].examples[0] == "u0" and got["Vue"].share == 50.0


def test_lab_field(spark):
    rows = [("a", 1000.0, 2000.0, "SLOW"), ("b", 3000.0, 2000.0, None), ("c", 2000.0, 2000.0, ""), ("d", 1.0, None, None), ("e", 5.0, 0.0, None)]
    pages = spark.createDataFrame(rows, "url string, lighthouse_lcp double, crux_lcp_percentile double, crux_lcp_category string")
    got = {r.url: r for r in statistics.lab_field(pages).collect()}
    assert (got["a"].verdict, got["a"].field_status, got["b"].verdict, got["c"].verdict, got["e"].verdict) == ("lab_better", "poor", "field_better", "match", None) and "d" not in got
    s = statistics.lab_field_summary(statistics.lab_field(pages)).withColumn("rules", advice.lab_field_rules()).first()
    assert (s.pages, s.mismatches, s.tendency) == (4, 2, "neutral") and s.rules == ["mismatches"]


def test_measurement_joins(spark):
    pages = spark.createDataFrame([("a", 1, None), ("b", None, None), ("c", None, 5)], "url string, x int, y int")
    source = spark.createDataFrame([("a", 9, 9), ("b", 7, None)], "url string, x int, y int")
    assert {r.url: (r.x, r.y, r.filled) for r in measurements.fill_missing(pages, source, "url", ("x", "y")).collect()} == {"a": (1, 9, 1), "b": (7, None, 1), "c": (None, 5, 0)}
    assert {r.url: (r.x, r.y) for r in measurements.overwrite(pages, source, "url", ("x", "y")).collect()} == {"a": (9, 9), "b": (7, None), "c": (None, 5)}
    assert [r.url for r in measurements.unmeasured(pages, source).collect()] == ["c"]
    c = measurements.coverage(pages, spark.createDataFrame([("a", True), ("b", False)], "url string, ok boolean")).first()
    assert (c.sampled, c.succeeded, c.failed, c.skipped, c.enough) == (2, 1, 1, 1, False)
    many = spark.createDataFrame([("https://h/",)] + [(f"https://h/{i}",) for i in range(20)], "url string")
    assert measurements.sample_pages(many, 0.2).count() == 5


def fold(rows):
    delay, seen, out = requests.FIRST_DELAY, [], []
    for t, ok in rows:
        seen = [*seen, (t, ok)][-20:]
        delay = requests.next_delay(delay, len(seen), sum(x for x, _ in seen) / len(seen), sum(not o for _, o in seen) / len(seen))
        out.append(delay)
    return out


def log(spark, n=60):
    rng = random.Random(3)
    rows = [(d, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i, round(rng.uniform(0.1, 5), 2), rng.random() < 0.9) for d in ("a", "b") for i in range(n)]
    return rows, spark.createDataFrame(rows, "domain string, ts timestamp, seq long, response_time double, success boolean")


def test_adaptive_delay(spark):
    rows, frame = log(spark)
    got = {(r.domain, r.seq): r.delay for r in requests.adaptive_delay(frame).collect()}
    for d in ("a", "b"):
        expected = fold([(t, ok) for dd, _, _, t, ok in rows if dd == d])
        assert [got[d, i] for i in range(60)] == pytest.approx(expected)
    assert requests.adaptive_delay(frame.limit(0)).count() == 0
    assert requests.next_delay(1.0, 2, 99, 1) == 1.0 and requests.next_delay(9.0, 5, 0.1, 0.5) == 10.0 and requests.next_delay(0.5, 5, 0.1, 0.0) == 0.5


def test_token_bucket(spark):
    rng = random.Random(1)
    at = sorted(rng.uniform(0, 30) for _ in range(40))
    start = dt.datetime(2024, 1, 1)
    frame = spark.createDataFrame([("a", start + dt.timedelta(seconds=t), i) for i, t in enumerate(at)], "domain string, ts timestamp, seq long")
    tokens, clock, expected = 2.0, at[0], []
    for t in at:  # first come, first served
        now = max(clock, t)
        tokens = min(2.0, tokens + (now - clock) * 1.0)
        clock = now
        if tokens < 1:
            clock += 1 - tokens
            tokens = 1.0
        tokens -= 1
        expected.append(clock - t)
    got = [r.wait for r in requests.token_bucket(frame, 1.0, 2.0).orderBy("seq").collect()]
    assert got == pytest.approx(expected, abs=1e-4)


def test_health(spark):
    rows = [("c", i, ok) for i, ok in enumerate([True, True, True, True, False, True, False, True, False, False, False, False])]
    got = [r.health for r in requests.context_health(spark.createDataFrame(rows, "context string, seq long, success boolean")).orderBy("seq").collect()]
    assert got == ["healthy"] * 6 + ["degraded"] * 4 + ["degraded", "degraded"]
    uses = [("p", i, ok, b) for i, (ok, b) in enumerate([(False, False), (False, False), (True, False), (False, True), (False, True), (False, True)])]
    got = [r.health for r in requests.proxy_health(spark.createDataFrame(uses, "proxy string, seq long, success boolean, blocked boolean")).orderBy("seq").collect()]
    assert got == ["healthy", "degraded", "degraded", "degraded", "degraded", "retired"]


def test_failures_cache_and_eviction(spark):
    rows = spark.createDataFrame([("u", 1, False, "Timeout", "timeout"), ("u", 2, False, "invalid url x", "other"), ("v", 3, True, None, None)], "url string, seq long, success boolean, error string, error_type string")
    assert [tuple(r) for r in requests.failures(rows).collect()] == [("u", "invalid url x", 2, False)]
    t = dt.datetime(2024, 1, 1)
    cache = spark.createDataFrame([(f"k{i}", t + dt.timedelta(hours=i * 9), 10, i, f"h{i}", t + dt.timedelta(hours=i)) for i in range(6)], "key string, created_at timestamp, bytes long, hit_count long, prompt_hash string, expires_at timestamp")
    assert {r.key for r in requests.evict_oldest(cache, 35).collect()} == {"k3", "k4", "k5"}
    assert requests.not_expired(cache, t + dt.timedelta(hours=3)).count() == 3
    assert advice.cache_statistics(cache).first().hits == 15
    newer = cache.limit(1).withColumn("bytes", F.lit(99).cast("long"))
    assert advice.put_cache(cache, newer).filter("bytes = 99").count() == 1 and advice.put_cache(cache, newer).count() == 6


def test_selectors(spark):
    t = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([("s", "p", "#a", t, True), ("s", "p", "#a", t + dt.timedelta(days=1), False), ("s", "q", "#b", t - dt.timedelta(days=80), True)], "site string, purpose string, selector string, ts timestamp, success boolean")
    found = selectors.from_events(events)
    got = {r.purpose: r for r in found.collect()}
    assert got["p"].confidence == pytest.approx(3 / 5 * 0.95) and got["q"].confidence == pytest.approx(0.75) and got["q"].reliability == pytest.approx(0.5 * 0.95 + 0.75 * 0.05)
    r = selectors.lifecycle_report(found, "2024-01-12 00:00:00").first()
    assert (r.selectors, r.stale, r.expired) == (2, 0, 1) and r.rules == ["remove_expired"]
    primary = spark.createDataFrame([("s", "p", "#a", 1, 9, 0.5)], "site string, purpose string, selector string, success long, failure long, confidence double")
    alts = spark.createDataFrame([("s", "p", "#b", 9, 1, 0), ("s", "p", "#c", 4, 0, 1), ("s", "p", "#d", 10, 0, 2)], "site string, purpose string, alternative string, success long, failure long, pos long")
    assert selectors.promotions(primary, alts).first().promoted == "#d"
    new, rest = selectors.promote(primary, alts)
    assert new.first().selector == "#d" and {x.alternative for x in rest.collect()} == {"#a", "#b", "#c"} and rest.orderBy("pos").first().alternative == "#a"
    patterns = spark.createDataFrame([("p", "#g"), ("p", "#b")], "purpose string, selector string")
    assert [(x.selector, x.confidence) for x in selectors.fallbacks(primary, alts, patterns).collect()] == [("#a", 0.5), ("#b", 0.4), ("#c", 0.4), ("#d", 0.4), ("#g", 0.3)]


def test_stable_selectors(spark):
    rows = [(1, "button", {"data-testid": "buy", "id": "css-1a2b", "class": "btn-x css-9z y"}, "Buy now")]
    got = [(r.selector, r.stability, r.confidence) for r in selectors.stable_candidates(spark.createDataFrame(rows, "element int, tag string, attributes map<string,string>, text string")).orderBy("rank").collect()]
    assert got == [('[data-testid="buy"]', "very_high", 0.99), ('button:has-text("Buy now")', "medium", 0.75), (".btn-x", "medium", 0.7), (".y", "low", 0.5)]
    shapes = spark.createDataFrame([("#main",), ("#css-12ab",), (".x",), ('[name="q"]',), ("div",), ("[data-testid=a]",)], "s string")
    assert [(r.x.stability, r.x.confidence) for r in shapes.select(selectors.stability(F.col("s")).alias("x")).collect()] == [("high", 0.9), ("low", 0.4), ("medium", 0.6), ("high", 0.92), ("medium", 0.5), ("very_high", 0.98)]
    caps = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "engine string, capability string")
    assert [tuple(r) for r in selectors.missing_capabilities(caps).collect()] == [("b", ["y"])]
    results = spark.createDataFrame([("u", "a", 0, True, "1"), ("u", "b", 1, False, "1"), ("u", "c", 2, True, "2")], "url string, engine string, pos int, success boolean, data string")
    assert {(r.engine, r.kind) for r in selectors.engine_discrepancies(results).collect()} == {("b", "success"), ("c", "data")}
    assert not selectors.engine_verdicts(results).first().all_passed


def test_evidence(spark):
    rows = spark.createDataFrame([("u", 5.0), ("v", 1.0)], "url string, x double")
    e = evidence.threshold_evidence(rows, "c", "slow", F.col("x"), ">", 3, "s", F.lit("warning"))
    m = evidence.model_evidence(rows.withColumn("finding", F.lit("advice")), "c", F.col("x") > 3, cap="odd")
    assert [r.url for r in e.collect()] == ["u"] and {r.url: r.confidence for r in m.collect()} == {"u": "High", "v": "Medium"}
    assert {r.finding: r.confidence for r in evidence.combined_confidence(e.unionByName(m)).collect()} == {"slow": "High", "advice": "Medium"}


def test_advice(spark):
    text = "- [I:9 C:8 E:7 = ICE:6.5] Fix titles\nImpact: x\n- [I:2 C:2 E:2 = ICE:1] later"
    rows = spark.createDataFrame([(1, text), (2, "[I:10 C:5 E:8] alone"), (3, "none"), (4, None)], "id int, response string")
    got = [(r.id, r.action, r.ice, r.tier, r.quick_win) for r in advice.scored_lines(rows).orderBy("id", "pos").collect()]
    assert got == [(1, "Fix titles", 6.5, "critical", True), (1, "later", 1.0, "low", False), (2, "alone", 4.0, "high", True)]
    claims = spark.createDataFrame([(1, "3 pages with missing title tags; 10% of pages have thin content")], "id int, response string")
    metrics = spark.createDataFrame([("missing_titles", 3), ("thin_content", 4)], "metric string, pages long")
    assert {(r.kind, r.claimed, r.actual, r.holds) for r in advice.check_claims(claims, metrics, 40).collect()} == {("count", 3.0, 3.0, True), ("percentage", 10.0, 10.0, True)}
    fields = spark.createDataFrame([("Score: 5\nnope\nTITLE : x: y\nscore: 9",)], "r string").select(advice.parse_fields(F.col("r"), ("score", "title")).alias("x")).first().x
    assert fields == {"score": "5", "title": "x: y"}


def test_api(spark):
    rows = [("https://h/api/users/1?x=1", "GET", "xhr", 0, None), ("https://h/api/users/2", "GET", "xhr", 1, '{"a": [1], "d": "2024-01-01"}'), ("https://h/a.js", "GET", "xhr", 2, None), ("https://h/page", "GET", "document", 3, None)]
    found = api.endpoints(spark.createDataFrame(rows, "url string, method string, kind string, seq long, body string"))
    r = found.first()
    assert found.count() == 1 and (r.path, r.calls, r.tag, r.hosts) == ("/api/users/{id_2}", 2, "api", ["h"]) and r.examples[0].endswith("/1?x=1") and len(r.bodies) == 1
    assert json.loads(api.interface_description(found).first().operation)["calls"] == 2
    assert api.json_schema({"a": {"b": {"c": 1}}, "u": "http://x", "e": "a@b.c", "n": None, "f": 1.5, "t": True}) == {"type": "object", "properties": {"a": {"type": "object", "properties": {"b": {"type": "object", "properties": {"c": {"type": "object"}}}}}, "u": {"type": "string", "example": "http://x", "format": "uri"}, "e": {"type": "string", "example": "a@b.c", "format": "email"}, "n": {"type": "null"}, "f": {"type": "number", "example": 1.5}, "t": {"type": "boolean", "example": True}}}
    doc = spark.createDataFrame([("https://h/openapi.json", "application/json", '{"openapi": "3"}'), ("https://h/docs", "text/html", "<div id=swagger-ui>"), ("https://h/", "text/html", "hi")], "u string, c string, b string")
    assert [r.x for r in doc.select(api.looks_like_documentation(F.col("u"), F.col("c"), F.col("b")).alias("x")).collect()] == ["spec", "ui", "other"]


ROBOTS = "User-agent: *\nDisallow: /admin\nDisallow:\n# c\nUser-Agent: Bot\nDisallow: /\nSitemap: https://h/s.xml\n"


def test_robots(spark):
    rows = spark.createDataFrame([("h", ROBOTS), ("i", None), ("j", "Disallow: /css/x")], "domain string, content string")
    got = {r.domain: r for r in site_files.robots_analysis(rows).collect()}
    assert got["h"].sitemaps == ["https://h/s.xml"] and got["h"].disallowed == ["/admin"] and got["h"].errors == ["blocks_all"]
    assert got["i"].errors == [] and got["i"].warnings == ["not_fetched"] and got["j"].errors == ["no_user_agent", "blocks_all"] and got["j"].warnings == ["blocks_assets"]
    assert {(r.domain, r.agent, r.rules) for r in site_files.rules_by_agent(rows).collect()} == {("h", "*", 2), ("h", "bot", 1), ("j", "*", 1)}
    counts = spark.createDataFrame([("h", 3, 2)], "domain string, broken long, orphans long")
    c = {r.domain: (r.efficiency, r.score) for r in site_files.crawlability(site_files.robots_analysis(rows), counts).withColumn("rules", advice.crawlability_rules()).collect()}
    assert c == {"h": (89, 20 + 10 + 25 + 15 + 5 + 10), "i": (70, 0 + 15 + 0 + 10 + 10 + 10), "j": (60, 20 + 0 + 0 + 10 + 10 + 5)}
    asked = spark.createDataFrame([("h", "x", "https://h/admin/1"), ("h", "x", "https://h/ok"), ("i", "x", "https://h/admin")], "domain string, agent string, url string")
    assert {r.url: r.allowed for r in site_files.fetch_decisions(asked, rows).collect()} == {"https://h/admin/1": False, "https://h/ok": True, "https://h/admin": True}


def test_sitemaps(spark):
    files = [
        ("r", '<!DOCTYPE x><sitemapindex xmlns="n"><sitemap><loc> a </loc></sitemap><sitemap><loc>b</loc></sitemap></sitemapindex>'),
        ("a", "<html><body><urlset><url><loc>https://h/1?x=1&amp;y=2</loc></url><url><loc><![CDATA[https://h/2]]></loc></url></urlset></body></html>"),
        ("b", "<n:urlset><n:url><n:loc>https://h/2</n:loc></n:url></n:urlset>"),
        ("c", "not xml"),
    ]
    rows = spark.createDataFrame(files, "url string, content string")
    roots = spark.createDataFrame([("r",), ("c",)], "url string")
    assert {r.url for r in sitemaps.sitemap_urls(rows, roots).collect()} == {"https://h/1?x=1&y=2", "https://h/2"}
    assert sitemaps.sitemap_urls(rows, roots, limit=1).first().url == "https://h/1?x=1&y=2"


def test_lighthouse(spark, tmp_path):
    report = {
        "requestedUrl": "https://h", "categories": {"performance": {"score": 0.876}, "best-practices": {"score": None}},
        "audits": {"largest-contentful-paint": {"numericValue": 1234.5}, "unused-css-rules": {"title": "t", "details": {"overallSavingsMs": 10, "items": [{}, {}]}}, "uses-text-compression": {"title": "no details"}, "dom-size": {"numericValue": 0},
                   "network-requests": {"details": {"items": [{}, {}, {}]}}, "resource-summary": {"details": {"items": [{"resourceType": "script", "requestCount": 2, "transferSize": 9}]}}},
    }
    (tmp_path / "page.json").write_text(json.dumps(report))
    (tmp_path / "bad.json").write_text("{bad")
    found = lighthouse.read(spark, str(tmp_path))
    s = lighthouse.scores(found).first()
    assert (s.page_id, s.lighthouse_performance, s.lighthouse_best_practices, s.lighthouse_pwa, s.lighthouse_lcp, s.lighthouse_fcp) == ("page", 87.6, None, 0.0, 1234.5, None)
    o = lighthouse.opportunities(found)
    assert [(r.id, r.savings_ms, r["items"]) for r in o.collect()] == [("unused-css-rules", 10.0, 2)]
    assert statistics.opportunity_rollup(o).first().pages == 1
    d = lighthouse.diagnostics(found).first()
    assert (d.dom_size, d.requests, d.resources) == (None, 3, {"script": 9})


def test_snapshots_and_archives(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    rows = spark.createDataFrame([("t", dt.datetime(2024, 1, d), float(60 + 10 * d), 1) for d in (3, 1, 2)] + [("o", dt.datetime(2024, 1, 1), 50.0, 1)], "domain string, crawl_date timestamp_ntz, technical_score double, odd int")
    archives.save_snapshots(rows, path)
    stored = archives.read_snapshots(spark, path)
    assert [r.technical_score for r in archives.history(stored, "t").collect()] == [70.0, 80.0, 90.0]
    assert [r.technical_score_change for r in archives.trend(stored.filter("domain = 't'"), ("technical_score",)).orderBy("crawl_date").collect()] == [None, 10.0, 10.0]
    with pytest.raises(ValueError):
        archives.save_snapshots(rows.limit(1), path)
    with pytest.raises(ValueError):
        archives.save_snapshots(rows.withColumn("domain", F.lit(None).cast("string")), path)
    from sitegrain.sources import html

    pages = html.page_table(spark.createDataFrame([(1, "https://h/", "<p>hello")], "page_id long, url string, html string"))
    for ts in ("2024-01-01_000000", "2024-02-01_000000"):
        archives.write_crawl(pages, str(tmp_path / "crawls"), "h", ts)
    stored = archives.read_crawls(spark, str(tmp_path / "crawls"))
    assert [r.crawl_ts for r in archives.crawls(stored).collect()] == ["2024-02-01_000000", "2024-01-01_000000"]
    assert archives.latest(stored).select("crawl_ts", "content_length").collect() == [("2024-02-01_000000", 5)]
    archives.write_pages_json(pages, str(tmp_path / "json"))
    back = archives.read_pages_json(spark, str(tmp_path / "json")).first()
    assert (back.url, back.word_count, back.content_text) == ("https://h/", 1, None)


def test_compare_and_seeds(spark):
    a, b = (spark.createDataFrame([(x,) for x in rows], "url string") for rows in (["x", "y", None], ["y", "z", None]))
    assert {(r.url, r.change) for r in links.compare_crawls(a, b).collect()} == {("x", "removed"), ("z", "added"), ("y", "kept"), (None, "kept")}
    crawled = spark.createDataFrame([("https://h/", 0)], "url string, level int")
    seeds = spark.createDataFrame([("https://h/a",), ("https://h/",), ("https://o/",)], "url string")
    assert {(r.url, r.level) for r in links.merge_seeds(crawled, seeds).collect()} == {("https://h/", 0), ("https://h/a", 1)}


def test_streams(spark, tmp_path):
    rows, frame = log(spark, 30)
    source = str(tmp_path / "in")
    frame.filter("seq < 20").coalesce(1).write.parquet(source)
    read = lambda: spark.readStream.schema(frame.schema).parquet(source)
    run = lambda df, name, **k: streams.start(df, str(tmp_path / name), str(tmp_path / f"{name}-state"), **k).awaitTermination(120)
    run(streams.adaptive_delay(read()), "delay")
    frame.filter("seq >= 20").coalesce(1).write.mode("append").parquet(source)
    run(streams.adaptive_delay(read()), "delay")  # resumes at its checkpoint
    got = {(r.domain, r.seq): r.delay for r in spark.read.parquet(str(tmp_path / "delay")).collect()}
    assert len(got) == 60
    for d in ("a", "b"):
        assert [got[d, i] for i in range(30)] == pytest.approx(fold([(t, ok) for dd, _, _, t, ok in rows if dd == d]))
    seen = []
    streams.start(streams.first_seen(read().withColumn("url", F.col("domain"))), "", str(tmp_path / "seen"), on_batch=lambda df, n: seen.append(df.count())).awaitTermination(120)
    assert sum(seen) == 2
    batch = streams.windowed_metrics(frame)
    assert batch.agg(F.sum("requests")).first()[0] == 60


def test_reports(spark):
    from sitegrain.operators import reports

    issues = spark.createDataFrame([(f"u{i}", i, "thin_content", float(i), "warning") for i in range(7)] + [("u1", 1, "missing_h1", 0.0, "critical")], "url string, crawl_seq long, issue_type string, measured double, severity string")
    text = reports.issue_report(issues).split("\n")
    assert text[0] == "thin_content: 7 pages, 0 critical" and text[1] == "  - u0 (0, warning)" and text[6] == "  ... and 2 more" and text[7] == "missing_h1: 1 pages, 1 critical"
    assert reports.issue_report(issues.limit(0)) == "" and reports.format_number(12345) == "12,345" and reports.format_number(None) == "-"
    rows = spark.createDataFrame([("a", 0, i, f"m{i}") for i in range(7)] + [("b", 1, 0, "x")], "url string, crawl_seq long, pos int, message string")
    assert [(r.url, r.errors, len(r.messages)) for r in reports.console_pages(rows).collect()] == [("a", 7, 5), ("b", 1, 1)]
    social = spark.createDataFrame([(0, "a", 10, 0), (1, "b", 0, 0), (2, "c", 90, 5)], "crawl_seq long, url string, og_score int, twitter_score int")
    best, worst = reports.social_extremes(social)
    assert [r.url for r in best.collect()] == ["c", "a"] and worst.first().url == "b"
    assert reports.hit_rate(spark.createDataFrame([(True,), (False,)], "hit boolean")).first().rate == 0.5
    assert {r.phase: r.seconds for r in reports.phase_totals(spark.createDataFrame([({"a": 1.0, "b": 2.0},), ({"a": 3.0},)], "timing map<string,double>")).collect()} == {"a": 4.0, "b": 2.0}
    states = spark.createDataFrame([("h", "1", "paused"), ("h", "2", "done"), ("i", "3", "paused")], "domain string, crawl_ts string, status string")
    assert [r.crawl_ts for r in reports.resumable(states).collect()] == ["3", "1"]
    when = spark.createDataFrame([("2024-01-02T03:04:05",), ("bad",)], "t string").select(reports.crawl_id(reports.parse_date(F.col("t"), F.lit(dt.datetime(2020, 1, 1)).cast("timestamp"))).alias("x"))
    assert [r.x for r in when.collect()] == ["2024-01-02_030405", "2020-01-01_000000"]
    safe = spark.createDataFrame([("https://h/Checkout",), ("https://h/",)], "u string").select(reports.is_safe_target(F.col("u"), ("checkout",)).alias("x"))
    assert [r.x for r in safe.collect()] == [False, True]


def test_profiles(spark):
    pages = spark.createDataFrame([("https://h/p/1",), ("https://h/",), ("x",)], "url string")
    patterns = spark.createDataFrame([("https://h/p/", "product", 0), ("https://h/", "home", 1)], "pattern string, profile string, pos int")
    assert {r.url: r.profile for r in selectors.page_profiles(pages, patterns).collect()} == {"https://h/p/1": "product", "https://h/": "home", "x": None}
    sites = spark.createDataFrame([("a", "<div data-reactroot></div>"), ("b", "")], "site string, html string")
    overrides = spark.createDataFrame([("b", "vue")], "site string, framework string")
    assert {r.site: r.framework for r in selectors.framework_of(sites, overrides).collect()} == {"a": "react", "b": "vue"}
    current = spark.createDataFrame([(1, "#main"), (2, "#css-1ab2"), (3, ".css-1ab2")], "element int, selector string")
    candidates = spark.createDataFrame([(2, "[name=q]", 0.92), (2, ".x", 0.6)], "element int, selector string, confidence double")
    assert {r.element: (r.selector, r.action) for r in selectors.reanalyse(current, candidates).collect()} == {1: ("#main", "keep"), 2: ("[name=q]", "replace"), 3: (".css-1ab2", "review")}
    visits = spark.createDataFrame([("s", "p", dt.datetime(2024, 1, d)) for d in (1, 2)], "site string, page string, ts timestamp")
    assert selectors.profile_visits(visits).first().visits == 2
