import threading
import time

import pytest
from pyspark.sql import functions as F

from sitegrain.operators import api, sections
from sitegrain.streaming import crawl_state, progress


def test_a_section_that_raises_leaves_the_others(spark, tmp_path):
    def wrong(pages):
        raise KeyError("x")

    found = sections.Sections(
        spark.range(100),
        {
            "all": lambda p: p,
            "few": lambda p: p.filter("id < 3"),
            "lazily": lambda p: p.select(F.when(p.id == 50, F.raise_error(F.lit("no"))).otherwise(p.id).alias("x")),
            "missing": lambda p: p.select("nothing"),
            "eagerly": wrong,
        },
        f"file://{tmp_path}",
    )
    rows = {r.section: (r.status, r.error, r.rows) for r in found.results().collect()}
    assert rows == {"all": ("ok", None, 100), "few": ("ok", None, 3), "lazily": ("failed", "USER_RAISED_EXCEPTION", None), "missing": ("failed", "UNRESOLVED_COLUMN.WITH_SUGGESTION", None), "eagerly": ("failed", "KeyError", None)}
    assert found.read("few").count() == 3


def test_sections_can_be_cancelled(spark, tmp_path):
    def slow(pages):
        wait = F.udf(lambda x: time.sleep(60) or x, "long")
        return pages.select(wait("id").alias("id"))

    found = sections.Sections(spark.range(4), {"slow": slow, "never": slow, "quick": lambda p: p}, f"file://{tmp_path}")
    found.cancel("never")
    threading.Timer(6, lambda: found.cancel("slow")).start()
    began = time.time()
    assert {r.section: r.status for r in found.results().collect()} == {"slow": "cancelled", "never": "cancelled", "quick": "ok"}
    assert time.time() - began < 50


def files(spark, tmp_path, rows, schema, n):
    """A folder that a stream reads one file a batch."""
    for i in range(n):
        spark.createDataFrame(rows[i::n], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")


def test_progress_rows_are_the_counts_of_the_source(spark, tmp_path):
    rows = [(n, f"u{n}", n % 4 != 0) for n in range(50)]
    stream = files(spark, tmp_path, rows, "seq long, url string, ok boolean", 5)
    listener = progress.ProgressTable(f"file://{tmp_path}/progress", ("watched",))
    assert progress.read_progress(spark, f"file://{tmp_path}/progress").count() == 0
    spark.streams.addListener(listener)
    try:
        query = progress.watched(stream, "seq", "url", ~F.col("ok")).writeStream.queryName("watched").format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
        until = time.time() + 30
        while time.time() < until and progress.read_progress(spark, f"file://{tmp_path}/progress").filter("done > 0").count() < 5:
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    table = progress.read_progress(spark, f"file://{tmp_path}/progress").filter("done > 0").orderBy("batch").collect()
    assert [r.done for r in table] == [10] * 5 and [r.input_rows for r in table] == [10] * 5
    assert [r.total for r in table] == [10, 20, 30, 40, 50] and sum(r.failed for r in table) == 13
    assert {r.last for r in table} <= {f"u{n}" for n in range(45, 50)}


def test_a_crawl_that_is_stopped_continues(spark, tmp_path):
    kinds = ("found", "failed", "found", "visited", "failed", "failed", "failed")
    rows = [("a" if n % 3 else "b", f"u{n % 23}", kinds[n * 7 % 11 % 7]) for n in range(240)] + [(None, "x", "found"), ("a", None, "found")]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    crawl_state.prepare(spark)
    try:
        stream = files(spark, tmp_path, rows, "domain string, url string, event string", 6)
        states = crawl_state.url_states(stream, shards=3)
        run = lambda name, **how: states.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/{name}/batch={n}")).option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(**how).start()
        run("whole", availableNow=True).awaitTermination()
        broken = run("broken", processingTime="0 seconds")
        until = time.time() + 120
        while time.time() < until and not broken.recentProgress:
            time.sleep(0.05)
        broken.stop()
        done = len(list((tmp_path / "broken").glob("batch=*")))
        run("broken", availableNow=True).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    assert 0 < done < 6
    assert sorted(map(tuple, read("broken").collect())) == sorted(map(tuple, read("whole").collect()))
    expected = {}
    for domain, url, event in rows:
        if url:
            seen, failures = expected.get((domain or "", url), (False, 0))
            expected[domain or "", url] = seen or event == "visited", failures + (event == "failed")
    expected = {k: ("visited" if seen else "failed" if n >= 3 else "queued", n) for k, (seen, n) in expected.items()}
    assert {(r.domain, r.url): (r.status, r.attempts) for r in crawl_state.latest(read("broken")).collect()} == expected
    assert {r.domain: r.status for r in crawl_state.resume_point(read("broken")).collect()}[""] == "paused"


def test_fields_of_all_bodies(spark):
    bodies = [("a", '{"k": 1, "d": {"when": "2026-01-01", "deep": {"er": {"est": 1}}}, "l": [1, "x", null]}'), ("a", '{"k": "https://h"}'), ("a", "{"), ("a", None), ("b", "[]"), ("b", "3.5")]
    log = spark.createDataFrame(bodies, "e string, body string")
    found = {(r.e, r.path): (r.types, r.formats, r.found, r.example) for r in api.body_fields(log, ["e"]).collect()}
    assert found["a", "$"] == (["object"], [], 2, None) and found["a", "$.k"] == (["integer", "string"], ["uri"], 2, "1")
    assert found["a", "$.d.when"] == (["string"], ["date"], 1, "2026-01-01") and found["a", "$.l[]"] == (["integer", "null", "string"], [], 3, "1")
    assert found["b", "$"] == (["array", "number"], [], 2, "3.5") and ("a", "$.d.deep.er.est") not in found
    assert ("a", "$.d.deep.er.est") in {(r.e, r.path) for r in api.body_fields(log, ["e"], depth=None).collect()}
    assert {(r.e, r.bodies) for r in api.body_types(log, ["e"]).collect()} == {("a", 2), ("b", 2)}
