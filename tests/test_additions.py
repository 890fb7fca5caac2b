"""Captures, lists, report files and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from sitegrain import __main__ as command
from sitegrain.operators import captures, selectors, sinks, statistics
from sitegrain.sources import lighthouse, lists


def test_captures_fill_the_page_table(spark):
    pages = spark.createDataFrame([("a", 9), ("b", 9)], "url string, css_bytes long")
    requests = spark.createDataFrame([("a", "https://x.y/f", "font", None, 2), ("a", "https://x.y/g", "font", 7, 1), ("a", "/local", "stylesheet", 5, 3)], "url string, request_url string, kind string, bytes long, seq int")
    console = spark.createDataFrame([("a", i, "error" if i % 2 else "warning", "m" * 600) for i in range(30)], "url string, seq int, level string, message string")
    visits = spark.createDataFrame([("a", "c"), ("b", None)], "url string, final_url string")
    a, b = captures.with_captures(pages, requests, console, visits).orderBy("url").collect()
    assert (a.css_bytes, a.font_bytes, a.page_bytes, a.third_party_requests, a.third_party_domains) == (5, 7, 12, 2, ["x.y"])
    assert [(f.url, f.size) for f in a.web_fonts] == [("https://x.y/g", 7), ("https://x.y/f", 0)]
    assert len(a.console_errors) == 10 and set(map(len, a.console_warnings)) == {500}
    assert a.was_redirected and a.redirect_chain == ["a", "c"] and a.redirect_count == 1
    assert (b.css_bytes, b.page_bytes, b.third_party_domains, b.console_errors, b.was_redirected, b.redirect_chain) == (0, 0, [], [], False, [])
    assert captures.with_captures(pages.limit(0), requests.limit(0), console.limit(0), visits.limit(0)).count() == 0


def test_proxies_of_odd_lines(spark):
    lines = ["", "# x", "socks5://h:1", "https://u@h", "h,x", ",1", "h , 2 , , u", "nonsense", None]
    got = {tuple(r) for r in lists.proxies(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {("h", 1, "socks5", None, None), ("h", 8080, "https", "u", None), ("h", 2, "http", "u", None)}


def test_addresses(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("# test data\ndefaults:\n  first_name: 'Ann'  # note\n  phone: \"555: 1\"\n\nserviceable:\n  - address: 1 High St\n    city: X\n  - address: 2 Low St\n")
    got = {tuple(r) for r in lists.addresses(spark, str(tmp_path / "a.yaml")).collect()}
    assert got == {("defaults", "first_name", "Ann"), ("defaults", "phone", "555: 1"), ("serviceable[0]", "address", "1 High St"), ("serviceable[0]", "city", "X"), ("serviceable[1]", "address", "2 Low St")}


def test_report_files(spark, tmp_path):
    table = spark.createDataFrame([(i, f"<{i}>", [i], None) for i in range(5)], "n int, s string, l array<int>, e double").coalesce(1)
    sinks.write_report(str(tmp_path / "r"), "A & B", {"numbers": table}, shown=3)
    page = (tmp_path / "r" / "report.html").read_text()
    assert "A &amp; B" in page and "&lt;2&gt;" in page and "&lt;3&gt;" not in page and "There are more rows." in page
    assert spark.read.json(str(tmp_path / "r" / "numbers")).count() == 5


def test_lighthouse_files(spark, tmp_path):
    report = {"requestedUrl": "u", "categories": {"performance": {"score": 0.5}}, "audits": {"unused-javascript": {"title": "t", "details": {"overallSavingsMs": 3, "items": [{}]}}, "screenshot-thumbnails": {"details": {"items": [{"timing": 1}]}}}}
    raw = spark.createDataFrame([("p", json.dumps(report)), ("q", "{"), ("r", None)], "page_id string, json string")
    lighthouse.write_reports(lighthouse.parse(raw, "json"), str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l" / "scores")).select("page_id", "lighthouse_performance").collect() == [("p", 50.0)]
    assert spark.read.json(str(tmp_path / "l" / "opportunities")).count() == 1
    assert [tuple(r) for r in lighthouse.screenshots(raw, "json").collect()] == [("p", 0, '{"timing":1}')]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 999, 1000])
def test_ranks_by_ranges(spark, n):
    import random

    rng = random.Random(n)
    values = [rng.choice([rng.gauss(0, 1), float(rng.randint(0, 3)), 1e9 * rng.random() ** 9]) for _ in range(n)]
    rows = [(g, v) for g in ("a", None) for v in values] + [("a", None), ("only null", None)]
    got = {r.g: r for r in statistics.statistics(spark.createDataFrame(rows, "g string, v double"), "v", ("g",)).collect()}
    ordered = sorted(values)
    assert got.keys() == {"a", None}
    for r in got.values():
        assert r["count"] == n and r.median == (ordered[(n - 1) // 2] + ordered[n // 2]) / 2 and r.p90 == ordered[int(n * 0.9)]
    assert statistics.statistics(spark.createDataFrame([], "v double"), "v").count() == 0


def test_ranks_beside_an_outlier(spark):
    """Ranges follow the ranks, not the values: one huge value does not put the rest into one range."""
    n = 60_000
    rows = spark.range(n).select(F.when(F.col("id") == 0, 1e12).otherwise(F.col("id") * 0.25).alias("v"))
    found = statistics.statistics(rows, "v")
    r = found.first()
    assert (r["count"], r["max"]) == (n, 1e12) and (r.median, r.p90) == ((n // 2 + n // 2 + 1) * 0.125, (int(n * 0.9) + 1) * 0.25)
    _, held = statistics.near_ranks(rows, "v")
    assert 0 < held.count() < n * 0.002


def test_tables_go_with_their_run(spark):
    from pathlib import Path

    from sitegrain.sources.shared import RUN, scratch_path, scratch_run, written

    where = lambda table: Path(table._scratch.removeprefix("file://"))
    with pytest.raises(ZeroDivisionError), scratch_run(spark):
        outer = written(spark.range(3), "outer")
        with scratch_run(spark):
            inner = written(outer, "inner")
            stays = written(inner, "stays", scratch_path(spark, "stays", kept=True))
            assert where(inner).exists()
        assert where(outer).exists() and not where(inner).exists() and outer.count() == 3
        1 / 0
    assert not where(outer).exists() and spark.conf.get(RUN, None) is None
    assert stays.count() == 3


def test_stored_selectors_of_generated_candidates(spark):
    rows = [("e", ".a", 0.9, 1, True), ("e", "#b", 0.8, 2, False), ("e", "#c", 0.7, 3, False), ("e", "#d", 0.6, 5, False), ("f", "#x", 0.5, 1, True)]
    got = selectors.stored_selectors(spark.createDataFrame(rows, "element string, selector string, confidence double, rank int, dynamic boolean")).collect()
    assert [tuple(r) for r in got] == [("e", "#b", 0.8, ["#c"])]


def test_command_line(spark, capsys, tmp_path, monkeypatch):
    assert command.main(["list"]) == 0 and "page_facts" in capsys.readouterr().out.split()
    assert command.main(["run", "page_facts", "/root/testdata/sf0.001", "--out", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0
    with pytest.raises(SystemExit):
        command.main(["run", "nothing", "/root/testdata/sf0.001"])
    monkeypatch.setattr(command, "SECTIONS", ("crawl_summary", "prioritised_issues"))
    assert command.main(["report", "/root/testdata/sf0.001", str(tmp_path / "r")]) == 0
    assert "missing_canonical" in (tmp_path / "r" / "report.html").read_text()
