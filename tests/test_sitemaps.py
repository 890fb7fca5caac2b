import gzip
import resource

import pytest

from sitegrain.sources import sitemaps


def read(content):
    return list(sitemaps.entries(sitemaps._pieces(content)))


def urlset(*urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


def test_entities_sections_namespaces_and_wrappers():
    text = """<?xml version="1.0" encoding="utf-8"?><!DOCTYPE html [<!ENTITY x "y">]><html><body>
    <s:urlset xmlns:s="http://x"><s:url><s:loc> https://h/?a=1&amp;b=&#50;&#x33;&b=&eacute;&nope;&lt; </s:loc><s:lastmod>2026-01-01</s:lastmod></s:url>
    <url><loc><![CDATA[https://h/?a&b&amp;c]]></loc><image:image><image:loc>i</image:loc></image:image></url><url><loc> </loc></url><url/></s:urlset></body></html>"""
    assert read(text) == [("page", "https://h/?a=1&b=23&b=é&nope;<", "2026-01-01"), ("page", "https://h/?a&b&amp;c", None)]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_pieces_of_any_size(size, monkeypatch):
    text = urlset("a&amp;b", "<![CDATA[c&d]]>", "é&b=1", "x&#233;")
    data = ("<?xml version='1.0' encoding='iso-8859-1'?>" + text).encode("latin-1")
    expected = [("page", u, None) for u in ("a&b", "c&d", "é&b=1", "xé")]
    assert read(data) == expected and read(text.encode("utf-16")) == expected
    pieces = lambda d: (d[i : i + size] for i in range(0, len(d), size))
    assert list(sitemaps.entries(iter([data[:60], *pieces(data[60:])]))) == expected
    packed = gzip.compress(text.encode()[:40]) + gzip.compress(text.encode()[40:])
    assert list(sitemaps.entries(iter([packed[:2], *pieces(packed[2:])]))) == expected


def test_faults_keep_what_came_before():
    assert [k for k, *_ in read("<urlset><url><loc>a</loc></url><url><loc>b</url></urlset>")] == ["page", "error"]
    assert [k for k, *_ in read("<urlset><url><loc>a</loc></url>")] == ["page", "error"]
    packed = gzip.compress(urlset(*map(str, range(200_000))).encode())
    for broken in (packed[:-3] + b"xyz", packed[: len(packed) // 2]):
        kinds = [k for k, *_ in read(broken)]
        assert kinds.count("page") > 50_000 and kinds[-1] == "error"
    assert read("<html>no map</html>") == [] and read("") == [] and read(None) == []
    assert [k for k, *_ in read("<urlset><url><loc><![CDATA[" + "x" * 3_000_000)] == ["error"]


def test_fifty_megabytes_in_bounded_memory(tmp_path):
    path = tmp_path / "large.xml.gz"
    with gzip.open(path, "wb", compresslevel=1) as f:
        f.write(b"<urlset>")
        for n in range(500_000):
            f.write(b"<url><loc>https://www.example.com/a/rather/long/path/to/a/page/%d?q=%d</loc><lastmod>2026-01-01</lastmod></url>" % (n, n))
        f.write(b"</urlset>")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert sum(k == "page" for k, *_ in sitemaps.entries(sitemaps._read(str(path)))) == 500_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 20_000  # KB


def test_walk_over_cycles_and_depth(spark, tmp_path):
    index = lambda *urls: "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"
    files = [("i0", index("i1", "m0", "i0")), ("i1", index("i0", "i2", "m1")), ("i2", index("m2", "missing")), ("m0", urlset("a", "b")), ("m1", urlset("b", "c")), ("m2", urlset("d")), ("m9", urlset("unreached")), ("none", None)]
    for n, (url, content) in enumerate(files):
        (tmp_path / str(n)).write_bytes(gzip.compress((content or "").encode()))
    held = spark.createDataFrame(files, "url string, content string")
    paths = spark.createDataFrame([(u, f"file://{tmp_path}/{n}") for n, (u, _) in enumerate(files)], "url string, path string")
    roots = spark.createDataFrame([("i0",), (None,)], "url string")
    expected = {("a", None, 1, "m0"), ("b", None, 1, "m0"), ("c", None, 2, "m1"), ("d", None, 3, "m2")}
    assert {tuple(r) for r in sitemaps.sitemap_pages(held, roots).collect()} == expected
    assert {tuple(r) for r in sitemaps.sitemap_pages(paths, roots).collect()} == expected
    assert {r.url for r in sitemaps.sitemap_urls(held, roots, 2).collect()} == {"a", "b"}
    assert [r.url for r in sitemaps.sitemap_urls(held, roots, None, 2).collect()] == ["a", "b"]
