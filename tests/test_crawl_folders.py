import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, Not

from sitegrain.sources import crawl_folders as cf


def pages(spark, n=6):
    return spark.range(n).select(F.concat(F.lit("https://h/"), "id").alias("url"), F.lit("abc").alias("content_text"), F.lit("x").alias("nothing_known"), F.when(F.col("id") % 2 == 0, "a.com").otherwise("b.com").alias("domain"), F.concat(F.lit("2026-0"), (F.col("id") % 3 + 1).cast("string")).alias("crawl_ts"))


def test_round_trip_and_filters(spark, tmp_path):
    path = f"file://{tmp_path}"
    cf.write_pages(pages(spark), path)
    back = cf.read_pages(spark, path)
    assert sorted((r.domain, r.crawl_ts, r.url, r.content_length) for r in back.collect()) == sorted((r.domain, r.crawl_ts, r.url, 3) for r in pages(spark).collect())
    assert "nothing_known" not in back.columns
    only = back.filter((F.col("domain") == "a.com") & (F.col("crawl_ts") > "2026-01"))
    assert {r.url for r in only.collect()} == {"https://h/2", "https://h/4"}


def test_crawls_that_filters_rule_out_are_not_opened(spark, tmp_path):
    path = f"file://{tmp_path}"
    cf.write_pages(pages(spark), path)
    reader = cf.CrawlReader(path, "pages")
    kept = [EqualTo(("domain",), "a.com"), GreaterThan(("crawl_ts",), "2026-01"), EqualTo(("page_id",), "x"), Not(EqualTo(("domain",), "c"))]
    assert list(reader.pushFilters(kept)) == kept[2:]
    assert {(p.domain, p.crawl_ts) for p in reader.partitions()} == {("a.com", "2026-02"), ("a.com", "2026-03")}
    for f in (tmp_path / "b.com").rglob("part-*"):  # what cannot be opened is noticed only when it is asked for
        f.unlink()
    assert cf.read_pages(spark, path).filter("domain = 'a.com'").count() == 3
    with pytest.raises(Exception, match="part-"):
        cf.read_pages(spark, path).filter("domain = 'b.com'").count()


def test_a_write_that_is_killed_leaves_no_half_crawl(spark, tmp_path):
    import pyarrow as pa

    path = f"file://{tmp_path}"
    writer = cf.CrawlWriter(path, "pages", False)
    batch = pa.record_batch({"domain": ["a", "a"], "crawl_ts": ["t", "t"], "page_id": ["1", None], "value": ['{"url":"u"}', '{"url":"v"}']})
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))
    assert cf.scan(spark, path).count() == 0  # killed here: files without a manifest
    writer.abort([first, None])
    assert len(list(tmp_path.rglob("part-*"))) == 1
    writer.commit([second, None])
    assert sorted(r.page_id or "" for r in cf.scan(spark, path).collect()) == ["", "1"]
    failing = spark.range(8, numPartitions=4).select(F.lit("b").alias("domain"), F.lit("t").alias("crawl_ts"), F.lit("p").alias("page_id"), F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise("{}").alias("value"))
    with pytest.raises(Exception, match="lost"):
        cf.store(failing, path, None, None, "pages")
    assert cf.scan(spark, path).filter("domain = 'b'").count() == 0


def test_replaced_parts_and_documents_of_others(spark, tmp_path):
    path = f"file://{tmp_path}"
    one = spark.createDataFrame([("1", '{"url":\n"u"}')], "page_id string, value string")
    cf.store(one, path, "a", "t", "pages")
    cf.store(one, path, "a", "t", "pages")
    assert cf.scan(spark, path).count() == 2
    cf.store(one, path, "a", "t", "pages", replace=True)
    assert [json.loads(r.value) for r in cf.scan(spark, path).collect()] == [{"url": "u"}]
    (tmp_path / "a" / "t" / "pages" / "x.y.json").write_text('{"url": "w", "word_count": 3}')
    (tmp_path / "a" / "t" / "pages" / "bad.json").write_text("{")
    (tmp_path / "a" / "t" / "pages" / "notes.txt").write_text("{}")
    assert sorted((r.url, r.word_count) for r in cf.read_pages(spark, path).collect()) == [("u", None), ("w", 3)]
    assert {r.page_id for r in cf.scan(spark, path).collect()} == {"1", "x.y", "bad"}
    for domain in ("../a", "", ".a"):
        with pytest.raises(Exception, match="folder"):
            cf.store(one, path, domain, "t", "pages")


def test_reports_and_analysis(spark, tmp_path):
    path = f"file://{tmp_path}"
    cf.write_reports(spark.createDataFrame([("p1", '{"categories":{"performance":{"score":0.5}}}'), ("p2", "no json")], "page_id string, report string"), path, "a", "t")
    assert [(r.page_id, r.report.categories["performance"].score) for r in cf.read_reports(spark, path).collect()] == [("p1", 0.5)]
    cf.write_analysis({"security": spark.range(3), "none": spark.range(0)}, path, "a", "t")
    cf.write_analysis({"security": spark.range(2)}, path, "a", "t")
    assert sorted(tuple(r) for r in cf.read_analysis(spark, path, "security", "id long").collect()) == [("a", "t", 0), ("a", "t", 1)]
    assert cf.read_analysis(spark, path, "none", "id long").count() == 0
    assert cf.scan(spark, f"{path}/nowhere").count() == 0
