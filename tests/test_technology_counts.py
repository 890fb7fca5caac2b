import re
from collections import Counter

from sitegrain.functions import technologies
from sitegrain.plans import slate

PAGES = [
    '<script src="https://cdn.jsdelivr.net/npm/vue.js"></script><link href="https://fontawesome.com/x.css">',
    '<meta name="generator" content="WordPress 6"><script src="/wp-content/jquery.min.js"></script>',
    '<div id="root"></div><script src="https://d1.cloudfront.net/react.js"></script>',
    "<p>woocommerce on three d3 heaps</p>",
    "",
    None,
]


def plain(html):
    found = {n for n, p in technologies.ANY_CASE.items() if re.search(p, html, re.I)}
    found |= {n for n, p in technologies.AS_WRITTEN.items() if re.search(p, html)}
    for name, p in (("React", r'<(?:div)[^>]*\sid="(?:root|app)"'), ("Font Awesome", r'<i[^>]*class="[^"]*fa-'), ("WordPress", r'<meta[^>]*name="generator"[^>]*content="[^"]*wordpress')):
        if re.search(p, html, re.I):
            found.add(name)
    return found


def test_counts_of_all_technologies(spark, tmp_path):
    spark.createDataFrame([(i, f"https://h/{i}", h) for i, h in enumerate(PAGES)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    expected = Counter(t for h in PAGES if h for t in plain(h))
    got = {r.technology: r.pages for r in slate.technology_counts(spark, str(tmp_path)).collect()}
    assert got == expected and {"jsDelivr", "Font Awesome", "WordPress", "Amazon CloudFront", "WooCommerce"} <= got.keys()


def test_what_a_pattern_needs_is_in_what_it_finds():
    for _, pattern in [*technologies.ANY_CASE.items(), *technologies.AS_WRITTEN.items()]:
        assert "|".join(technologies._alternatives(pattern)) == pattern
    needs = {"adobe.*analytics": "analytics", r"jquery(?:[.-]\d+)?\.(?:min\.)?js": "jquery", r"\baem\b": "aem", "d3(?:\\.js)?": "d3", r"d3\.v[0-9]": "d3.v", "fbq\\(": "fbq(", "ab+c?d": "ab", "x(?:aaaa|b)y": "x"}
    assert {p: technologies._required(p) for p in needs} == needs


def test_detection_on_mixed_marks(spark):
    import random

    rng = random.Random(5)
    marks = "React react-dom __react vue.js jquery-3.js jquery.min.js D3.v4 three.min TimelineLite adobe x analytics salesforce commerce ga.js analytics.js GA.js wp-content aem. AEM <i class='a fa-x'> <div id=\"app\"> <i class=\"fa fa-x\"> zendesk-chat facebook pixel fbq( Fbq( relay.js dy.js atg.commerce bing.com/uet \n".split(" ")
    pages = [" ".join(rng.choice(marks) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    none = technologies.F.create_map().cast("map<string,string>")
    for r in frame.select("i", technologies.detect(technologies.F.col("html"), none).alias("t")).collect():
        assert set(r.t) == plain(pages[r.i]), pages[r.i]
