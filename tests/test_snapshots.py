import threading

import pytest
from pyspark.sql import functions as F

from sitegrain.sources import archives


def row(spark, domain="a", date="2026-01-01", pages=1):
    return spark.createDataFrame([(domain, date, pages, "x")], "domain string, crawl_date string, total_pages long, unknown string").withColumn("crawl_date", F.col("crawl_date").cast("timestamp_ntz"))


def test_of_two_writers_of_a_key_one_fails_whole(spark, tmp_path):
    path = f"file://{tmp_path}"
    for n in range(3):
        start, outcomes = threading.Barrier(2), []
        shared = row(spark, f"d{n}")

        def write(extra):
            rows = shared.unionByName(row(spark, f"{extra}{n}"))
            start.wait()
            try:
                archives.save_snapshots(rows, path)
                outcomes.append(extra)
            except ValueError:
                outcomes.append(None)

        threads = [threading.Thread(target=write, args=(x,)) for x in "pq"]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert sorted(x is None for x in outcomes) == [False, True]
        won = next(x for x in outcomes if x)
        stands = {r.domain for r in archives.read_snapshots(spark, path).collect() if r.domain.endswith(str(n))}
        assert stands == {f"d{n}", f"{won}{n}"}


def test_keys_twice_missing_and_there_already(spark, tmp_path):
    path = f"file://{tmp_path}"
    assert archives.read_snapshots(spark, path).count() == 0
    archives.save_snapshots(row(spark), path)
    for bad in (row(spark), row(spark, "b").unionByName(row(spark, "b")), row(spark, None), row(spark, "b", None)):
        with pytest.raises(ValueError):
            archives.save_snapshots(bad, path)
    archives.save_snapshots(row(spark, "b"), path)
    archives.save_snapshots(row(spark, "a").limit(0), path)
    found = archives.read_snapshots(spark, path)
    assert sorted((r.domain, r.total_pages) for r in found.collect()) == [("a", 1), ("b", 1)] and "unknown" not in found.columns


def test_the_claim_of_a_killed_writer(spark, tmp_path):
    path = f"file://{tmp_path}"
    archives.save_snapshots(row(spark, "a"), path)
    assert not archives.release_claim(spark, path)
    (tmp_path / "_claim").write_text("gone")
    with pytest.raises(TimeoutError):
        archives.save_snapshots(row(spark, "b"), path, wait=0.5)
    assert archives.release_claim(spark, path)
    archives.save_snapshots(row(spark, "b"), path)
    assert archives.read_snapshots(spark, path).count() == 2 and not list((tmp_path / "_staged").iterdir())
