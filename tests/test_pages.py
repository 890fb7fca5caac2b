"""Extraction and page-level operators on small pages worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sitegrain.functions import classify, scores, technologies, urls, vitals
from sitegrain.functions import text as tx
from sitegrain.operators import content, links, site, statistics, technical
from sitegrain.sources import html
from sitegrain.thresholds import Thresholds

RICH = """<!DOCTYPE html><html lang="en-GB"><head><title> A &amp; B </title><meta charset="utf-8">
<meta name="description" content="Short."><meta name="keywords" content="x, y"><meta name="viewport" content="width=device-width">
<meta name="robots" content="NOINDEX, follow"><meta property="og:title" content="one"><meta property="og:title" content="two"><meta name="twitter:card" content="bad">
<link rel="canonical" href="https://h/c"><link rel="alternate" hreflang="de" href="https://h/"><link rel="stylesheet" href="a.css">
<script src="b.js"></script><script src="c.js" async></script><script type="application/ld+json">{"@type":"Product","@graph":[{"@type":["Offer","X"]}]}</script>
<script type="application/ld+json">{bad</script><style>@font-face{src:x}</style></head>
<body><h1>Head <b>line</b></h1><h2>two</h2><p class="price-tag">Hello world<p>again
<img src="a.jpg" alt="A" width="1" height="2" loading="lazy"><img src="b.webp"><img src="c.png" alt="">
<a href="/in">in</a><a href="https://other/x#f">out</a><a href="mailto:x@y"></a><a href="//cdn/z" title="t"></a>
<button></button><button aria-label="b"></button><input name="q"><input type="hidden"><iframe src="https://youtube.com/e"></iframe>
<div itemscope itemtype="https://schema.org/Event"></div><div typeof="A B"></div></body></html>"""


def test_extracted_fields():
    p = html.extract(RICH, "https://h/")
    assert (p["title"], p["description"], p["keywords"], p["h1_tags"], p["h2_tags"]) == ("A & B", "Short.", ["x", "y"], ["Head line"], ["two"])
    assert (p["total_images"], p["images_without_alt"], p["lazy_images"], p["eager_images"]) == (3, 2, 1, 2)
    assert p["links"] == ["https://h/in", "https://other/x#f", "mailto:x@y", "https://cdn/z"]
    assert (p["internal_links"], p["external_links"]) == (3, 1)
    assert p["robots_directives"] == {"noindex": True, "nofollow": False, "noarchive": False}
    assert p["open_graph"] == {"og:title": "two"} and p["twitter_card"] == {"twitter:card": "bad"}
    assert (p["canonical_url"], p["viewport"], p["lang"], p["charset"]) == ("https://h/c", "width=device-width", "en-GB", "utf-8")
    assert p["hreflang"] == [{"hreflang": "de", "href": "https://h/"}]
    assert p["schema_types"] == ["Product", "Offer", "X", "Event", "A", "B"] and p["json_ld_errors"] == 1 and len(p["json_ld"]) == 1
    assert p["schema_errors"] == ["Product.name", "Product.image"] and p["schema_warnings"] == ["Product.offers", "Product.review"]
    assert (p["microdata_count"], p["rdfa_count"]) == (1, 1)
    assert (p["buttons_without_aria"], p["links_without_context"], p["inputs_without_labels"]) == (1, 1, 1)
    assert p["lcp_candidates"] == 3 and p["blocking_scripts"] == 2 and p["cls_risks"] == 4 and p["render_blocking"] == 3  # an empty async counts as none
    assert {"product", "video", "homepage"} <= set(p["page_types"]) and "article" not in p["page_types"]
    assert p["content_text"].startswith("A & B") and "Hello world again" in p["content_text"]


@pytest.mark.parametrize("markup", [None, "", "<", "<p", "</p></p>", "<a href=http://[bad>x</a>", "plain &lt; text", "<title>unclosed", "<b><i>x</b></i>" * 50])
def test_extraction_survives(markup):
    p = html.extract(markup, None)
    assert set(p) == set(html.EXTRACTED.names) and p["word_count"] == len(p["content_text"].split())


def test_robots_map_is_empty_without_a_tag():
    assert html.extract("<p>", "u")["robots_directives"] == {}


@pytest.mark.parametrize(
    ("data", "errors", "warnings"),
    [
        ({"@type": "FAQPage"}, ["FAQPage.mainEntity"], []),
        ({"@type": "FAQPage", "mainEntity": {"@type": "Question", "name": "q", "acceptedAnswer": {}}}, ["FAQPage.mainEntity[0].acceptedAnswer.text"], []),
        ({"@type": ["Article"], "headline": 1, "author": 1, "datePublished": 1, "dateModified": 1, "image": 1}, [], ["Article.publisher"]),
        ({"@type": "BreadcrumbList", "itemListElement": [{"position": 1, "item": "x"}, {"name": "n"}]}, ["BreadcrumbList.itemListElement[1].position"], []),
        ({"@type": "HowTo", "name": 1, "step": [{}], "totalTime": 1, "estimatedCost": 1, "supply": 1, "tool": 1}, ["HowTo.step[0].name"], []),
        ([{"@type": "Product"}], [], []),
        ({"@type": "Unknown"}, [], []),
    ],
)
def test_schema_rules(data, errors, warnings):
    assert html.validate_schema(data) == (errors, warnings)


def page(spark, rows):
    """Page rows from (url, title, description, h1, words, load, links, images, canonical)."""
    schema = "crawl_seq long, url string, title string, description string, h1_tags array<string>, word_count long, load_time double, links array<string>, images array<map<string,string>>, canonical_url string"
    base = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    return base.withColumns(
        {
            "images_without_alt": F.lit(0), "total_images": F.size("images"), "headers": F.create_map().cast("map<string,string>"), "console_errors": F.array().cast("array<string>"), "was_redirected": F.lit(False),
            "lighthouse_performance": F.lit(None).cast("double"), "buttons_without_aria": F.lit(0), "links_without_context": F.lit(0), "inputs_without_labels": F.lit(0), "hrefs": F.col("links"),
            "lazy_images": F.lit(0), "eager_images": F.lit(0), "image_bytes": F.lit(0),
        }
    )


@pytest.fixture(scope="module")
def site3(spark):
    root = "https://example.com/"
    return page(
        spark,
        [
            (root, "Example Site - Home", "Welcome to Example Site, your source for quality content.", ["Welcome"], 450, 1.2, [root + "about", root + "services"], [{"src": "logo.png", "alt": "L"}, {"src": "hero.jpg", "alt": ""}], root),
            (root + "about", "About Us - Example Site", "Learn more about Example Site and our mission.", ["About"], 350, 0.8, [root], [{"src": "team.jpg", "alt": "T"}], root + "about"),
            (root + "services", "", "", [], 150, 3.5, [root, root + "about"], [{"src": "service1.jpg"}, {"src": "service2.jpg"}], ""),
        ],
    )


def test_site3_issues(site3):
    found = {(r.issue_type, r.url.rsplit("/", 1)[1], r.severity) for r in technical.issue_rows(site3).collect()}
    assert found == {
        ("short_title", "", "warning"), ("short_title", "about", "warning"), ("short_description", "", "warning"), ("short_description", "about", "warning"),
        ("missing_title", "services", "critical"), ("missing_description", "services", "critical"), ("missing_h1", "services", "critical"),
        ("slow_page", "services", "warning"), ("thin_content", "services", "warning"), ("missing_canonical", "services", "warning"),
    }
    assert links.broken_internal_links(site3).count() == 0 and links.orphan_pages(site3).count() == 0
    s = site.image_summary(site3).first()
    assert (s.images, s.with_alt, s.convertible) == (5, 2, 5)
    c = site.crawl_summary(site3).first()
    assert (c.pages, c.words, c.avg_words, c.without_title, c.without_h1) == (3, 950, 316, 1, 1)


def test_thresholds_move_the_checks(site3):
    strict = Thresholds().overridden({"thin_words": "400", "slow_seconds": "bad"})
    assert strict.thin_words == 400 and strict.slow_seconds == 3.0
    assert technical.issue_rows(site3, strict).filter("issue_type = 'thin_content'").count() == 2
    assert Thresholds.from_env({"SEO_THRESHOLD_TITLE_MIN": "5"}).title_min == 5


def test_matrix_and_priorities(site3):
    rows = technical.page_matrix(site3).collect()
    assert [r.url.rsplit("/", 1)[1] for r in rows] == ["services", "", "about"] and rows[0].flags == ["title", "desc", "h1", "canonical", "thin", "slow", "security"] and rows[0].health == 30
    assert rows[0].title == "(No title)"
    order = [r.issue_type for r in technical.prioritised(technical.issue_rows(site3)).collect()]
    assert order[:2] == ["missing_description", "missing_title"] and set(order[2:4]) == {"missing_h1", "slow_page"}


def test_broken_and_orphans(spark):
    r = "https://example.com"
    broken = page(spark, [(r + "/", "t", "", [], 0, 0.0, [r + "/about", r + "/contact", "https://external.com", r + "/contact#x", "#top", "mailto:a@b"], [], ""), (r + "/about", "t", "", [], 0, 0.0, [r + "/"], [], "")])
    assert [(x.src, x.broken) for x in links.broken_internal_links(broken).collect()] == [(r + "/", [r + "/contact", r + "/contact", "mailto:a@b"])]
    orphan = page(spark, [(r + "/", "", "", [], 0, 0.0, [r + "/about"], [], ""), (r + "/about", "", "", [], 0, 0.0, [r + "/"], [], ""), (r + "/orphan", "", "", [], 0, 0.0, [r + "/"], [], "")])
    assert [x.url for x in links.orphan_pages(orphan).collect()] == [r + "/orphan"]
    assert [x.url for x in links.undiscovered(broken).collect()] == [r + "/contact", "https://external.com", "mailto:a@b"]
    assert links.broken_internal_links(broken.limit(0)).count() == 0 and links.orphan_pages(broken.limit(0)).count() == 0


def test_duplicate_titles(spark):
    rows = [(f"https://e/{i}", t, "", [], 0, 0.0, [], [], "") for i, t in enumerate(["a", "a", "b", "b", "b", None, None, ""])]
    assert sorted(map(tuple, technical.duplicate_titles(page(spark, rows)).collect())) == [("a", 2, "warning"), ("b", 3, "critical")]


def test_bfs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.level for r in links.bfs_levels(edges, roots).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {r.node for r in links.bfs_levels(edges, roots, 1).collect()} == {"a", "b", "c"}


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(("word", "n"), [("the", 1), ("hello", 2), ("beautiful", 3), ("", 1), ("rhythm", 1), ("Idea", 2)])
def test_syllables(spark, word, n):
    assert one(spark, tx.syllables(F.col("w")), w=word) == n


def test_reading_ease_and_grades(spark):
    for score, grade, band in ((95.0, "5th Grade", "90-100 maps to 5th Grade"), (89.5, "6th Grade", "Unknown range"), (30.0, "College", "30-49 maps to College"), (0.0, "College Graduate", "0-29 maps to College Graduate")):
        assert one(spark, tx.grade(F.col("s")), s=score) == grade and one(spark, tx.grade_range(F.col("s")), s=score) == band


def test_keywords_of_repeated_words(spark):
    docs = spark.createDataFrame([(1, "keyword " * 50 + "other text " * 50), (2, ""), (3, None), (4, "(Word) word. WORD! the")], "doc_id long, text string")
    top = {(r.doc_id, r.rank): (r.keyword, r.n, r.density) for r in content.top_keywords(docs).collect()}
    assert top == {(1, 1): ("keyword", 50, 50.0), (1, 2): ("text", 50, 50.0), (4, 1): ("word", 3, 100.0)}
    q = {r.doc_id: r for r in content.quality(docs).collect()}
    assert q[2].words == 0 and q[3].score == 0.0 and q[1].confidence == "High" and q[4].unique_words == 4
    read = {r.doc_id: r.grade for r in content.readability(docs).collect()}
    assert read[2] == "N/A"


@pytest.mark.parametrize(
    ("url", "normal", "issues"),
    [
        ("https://h/a/b/?x=1/#f", "https://h/a/b/?x=1", []),
        ("https://h/", "https://h/", ["no_keywords"]),
        ("http://h/12345/ABC_d_e_f", "http://h/12345/ABC_d_e_f", ["not_https", "not_readable", "underscores"]),
        ("https://h/a/b/c/d/e?p=1&q=2&r=3&s=4&s=5&t=", "https://h/a/b/c/d/e?p=1&q=2&r=3&s=4&s=5&t=", ["too_many_parameters", "too_deep"]),
        ("https://h/x;p=1/", "https://h/x;p=1", ["not_readable"]),
        ("not a url", "not a url", ["not_https", "not_readable"]),
    ],
)
def test_urls(spark, url, normal, issues):
    assert one(spark, urls.normalize(F.col("u")), u=url) == normal
    assert one(spark, urls.structure_issues(F.col("u")), u=url) == issues


def test_url_parts(spark):
    assert one(spark, urls.base_domain(F.col("d")), d="a.b.example.co.uk") == "example.co.uk"
    assert one(spark, urls.base_domain(F.col("d")), d="localhost") == "localhost"
    assert one(spark, urls.template(F.col("p")), p="/users/42/0123456789abcdef01234567/x/") == "/users/{id_1}/{token_2}/x"
    assert one(spark, urls.is_skipped(F.col("u")), u="https://h/a.PDF") and one(spark, urls.is_skipped(F.col("u")), u="https://h/cart/x") and not one(spark, urls.is_skipped(F.col("u"), False), u="https://h/cart/x")
    assert one(spark, urls.file_name(F.col("u")), u="https://a.b:8/x.y/z/") == "a_b_8_x_y_z" and one(spark, urls.file_name(F.col("u")), u="https://a/") == "a_index"
    assert one(spark, urls.is_api_request(F.col("u"), F.lit(None).cast("string")), u="https://h/v2/x") and not one(spark, urls.is_api_request(F.col("u"), F.lit("xhr")), u="https://h/x.js")
    assert one(spark, urls.tag(F.col("p")), p="/users/1") == "users" and one(spark, urls.tag(F.col("p")), p="/") == "default"
    rows = spark.createDataFrame([("https://h/a/", "../b"), ("https://h/", None), (None, "x")], "b string, h string")
    assert [r.x for r in rows.select(urls.join_url("b", "h").alias("x")).collect()] == ["https://h/b", None, None]


def test_vitals(spark):
    v = vitals
    assert one(spark, v.lcp_status(F.col("t"), F.lit(9)), t=2.0) == "good" and one(spark, v.lcp_status(F.col("t"), F.lit(2)), t=0.0) == "needs-improvement"
    assert one(spark, v.overall(F.lit("good"), F.lit(None).cast("string")), t=0) == "unknown" and one(spark, v.overall(F.lit("good"), F.lit("poor")), t=0) == "poor"
    assert one(spark, v.total_blocking_time(F.array(F.lit(40), F.lit(120), F.lit(51))), t=0) == 71.0
    assert one(spark, v.measured_status(F.lit(None).cast("double"), F.lit(301.0), F.lit(None).cast("double")), t=0).asDict() == {"lcp": "unknown", "fid": "poor", "cls": "good"}


@pytest.mark.parametrize(
    ("status", "body", "wall"),
    [(403, "Incident ID: 7", "imperva"), (403, "you are denied", "waf_block"), (403, "fine", None), (200, "Just a moment...</title> Ray ID: 1", "cloudflare"), (200, "one more step</title>", "challenge_page"), (200, "denied", None), (503, None, None)],
)
def test_firewalls(spark, status, body, wall):
    frame = spark.createDataFrame([(status, body)], "s int, b string")
    assert frame.select(classify.firewall(F.col("s"), F.col("b")).alias("x")).first().x == wall


def test_classifiers(spark):
    assert one(spark, classify.console_error(F.col("m")), m="x typeerror: CORS") == "TypeError" and one(spark, classify.console_error(F.col("m")), m="hm") == "Other"
    for d, c in (("www.facebook.com", "advertising"), ("x.twitter.com", "social"), ("my-analytics.io", "analytics"), ("badcriteo.com", "advertising"), ("fonts.gstatic.com", "cdn"), ("example.org", "other")):
        assert one(spark, classify.domain_category(F.col("d")), d=d) == c
    empty = F.lit("")
    assert one(spark, classify.form_field(F.lit("user_email"), empty, empty, empty, empty), t=0) == "email" and one(spark, classify.form_field(empty, empty, empty, empty, F.lit("tel")), t=0) == "phone"
    kind = lambda *f: one(spark, classify.form_type(F.array(*[F.lit(x) for x in f])), t=0)
    assert (kind("username", "password"), kind("username", "password", "email"), kind("cc_cvv"), kind("email", "message"), kind("city")) == ("login", "signup", "payment", "contact", "unknown")
    assert one(spark, classify.is_dynamic_value(F.col("v")), v="css-1a2b") and one(spark, classify.is_dynamic_value(F.col("v")), v="12345678abcdefghijklmnop") and not one(spark, classify.is_dynamic_value(F.col("v")), v="main menu")
    f = one(spark, classify.framework(F.col("h")), h='<div data-reactroot></div><script>__NEXT_DATA__</script>')
    assert f.framework == "react" and f.confidence == pytest.approx(0.7)
    assert one(spark, classify.framework(F.col("h")), h="plain").framework == "unknown"
    assert one(spark, classify.is_retryable(F.col("e"), F.lit(1)), e="Timeout") and not one(spark, classify.is_retryable(F.col("e"), F.lit(1)), e="Protocol error") and not one(spark, classify.is_retryable(F.col("e"), F.lit(3)), e="Timeout")
    off = lambda s, k=None: one(spark, classify.backs_off(F.lit(False), F.lit(s), F.lit(k).cast("string")), t=0)
    assert (off(429), off(500), off(404), off(0, "dns"), off(0, "browser_crash")) == (True, True, False, True, False)


def test_technologies(spark):
    frame = spark.createDataFrame([('<link href="https://fonts.googleapis.com"><script src="jquery-3.min.js">', {"Server": "nginx/1", "X-Vercel-Id": "a", "x-powered-by": "PHP"}), ("<p>", None)], "h string, m map<string,string>")
    found = [r.x for r in frame.select(technologies.detect(F.col("h"), F.col("m")).alias("x")).collect()]
    assert found == [["Google Font API", "Nginx", "PHP", "Vercel", "jQuery"], []]
    s = one(spark, technologies.summary(F.array(F.lit("Apache"), F.lit("Nginx"), F.lit("Shopify"))), t=0)
    assert (s.technologies, s.ecommerce, s.cms, s.server) == (3, "Shopify", None, "Apache")
    assert one(spark, technologies.category(F.col("t")), t="Cloudflare") == "CDN" and one(spark, technologies.version(F.col("t")), t="x-1.2.3.js") == "1.2.3"


def test_scores(spark):
    frame = spark.createDataFrame([("https://h", {"Strict-Transport-Security": "1", "X-FRAME-OPTIONS": "d"}), ("http://h", None)], "u string, h map<string,string>")
    assert [r.x for r in frame.select(scores.security_score(F.col("u"), F.col("h")).alias("x")).collect()] == [70, 0]
    og = F.create_map(F.lit("og:title"), F.lit("t"), F.lit("image"), F.lit("http://i"))
    assert one(spark, scores.open_graph_score(og)[0], t=0) == 35 and one(spark, scores.open_graph_score(og)[1], t=0) == ["og:description", "og:url", "og:type"]
    assert one(spark, scores.twitter_score(F.create_map(F.lit("twitter:card"), F.lit("odd")))[0], t=0) == 15
    for src, kind in (("a.JPG?x", "jpg"), ("a.jpeg", "jpeg"), ("/webp/a", "webp"), ("", "unknown"), ("a.svg", "svg"), ("x?f=.png", "unknown")):
        assert one(spark, scores.image_format(F.col("s")), s=src) == kind
    assert one(spark, scores.crawl_efficiency(F.lit(3), F.lit(2), F.lit(True), F.lit(0)), t=0) == 94 and one(spark, scores.crawl_efficiency(F.lit(90), F.lit(20), F.lit(False), F.lit(9)), t=0) == 0
    tags = F.array(F.struct(F.lit("x-default").alias("hreflang"), F.lit("https://h/").alias("href")))
    assert one(spark, scores.international_issues(F.lit("en"), tags, F.lit("latin1"), F.lit("https://h")), t=0) == ["invalid_hreflang:x-default", "not_utf8"]
    imgs = F.array().cast("array<map<string,string>>")
    assert one(spark, scores.mobile_issues(F.lit("width=320"), F.lit(11), imgs), t=0) == ["fixed_width", "no_srcset"] and one(spark, scores.mobile_score(F.array(F.lit("missing_viewport"), F.lit("no_srcset"))), t=0) == 40


def test_seven_numbers(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("b", 5.0), ("c", None)], "k string, v double")
    got = {r.k: r for r in statistics.statistics(rows, "v", ("k",)).collect()}
    assert (got["a"].p90, got["a"].median, got["a"]["count"], got["b"].stddev, got["b"].p90) == (10.0, 5.5, 10, 0.0, 5.0) and "c" not in got
    assert statistics.statistics(rows, "v").first().p90 == 9.0


def test_page_table_of_raw_pages(spark):
    raw = spark.createDataFrame([(1, "https://h/", RICH, "x"), (2, "u", None, "y")], "page_id long, url string, html string, title string")
    table = html.page_table(raw)
    rows = {r.url: r for r in table.collect()}
    assert rows["https://h/"].title == "A & B" and rows["u"].word_count == 0 and rows["u"].headers == {}
    s = {r.url: r for r in site.structured_data_rows(table).collect()}
    assert s["https://h/"].missing == ["VideoObject", "Organization"] and s["u"].score == 35
    assert html.page_table(raw.limit(0)).count() == 0
