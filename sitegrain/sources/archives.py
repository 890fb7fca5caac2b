"""Crawl archives and metric snapshots as partitioned tables."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PAGE, SNAPSHOT


def write_crawl(pages: DataFrame, path: str, domain: str, crawl_ts: str) -> None:
    """Append a crawl below ``path`` as domain=.../crawl_ts=...; page text gives way to its length."""
    kept = pages.withColumn("content_length", F.length("content_text")).drop("content_text")
    kept.withColumns({"domain": F.lit(domain), "crawl_ts": F.lit(crawl_ts)}).write.mode("append").partitionBy("domain", "crawl_ts").parquet(path)


def read_crawls(spark: SparkSession, path: str) -> DataFrame:
    """All crawls; filters on domain and crawl_ts read their folders alone."""
    stored = T.StructType([*(f for f in PAGE.fields if f.name != "content_text"), T.StructField("content_length", T.IntegerType()), T.StructField("domain", T.StringType()), T.StructField("crawl_ts", T.StringType())])
    return spark.read.schema(stored).parquet(path)


def crawls(archive: DataFrame) -> DataFrame:
    """(domain, crawl_ts, pages), newest first."""
    return archive.groupBy("domain", "crawl_ts").agg(F.count(F.lit(1)).alias("pages")).orderBy("domain", F.desc("crawl_ts"))


def latest(archive: DataFrame) -> DataFrame:
    """The pages of every domain's newest crawl."""
    newest = archive.groupBy("domain").agg(F.max("crawl_ts").alias("crawl_ts"))
    return archive.join(newest, ["domain", "crawl_ts"], "left_semi")


def read_pages_json(spark: SparkSession, path: str) -> DataFrame:
    """Page rows of a folder of JSON files: known fields only, unreadable files skipped, of a repeated URL the last."""
    rows = spark.read.schema(PAGE).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return last_by_url(rows)


def last_by_url(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("url").orderBy(F.desc("crawl_seq"))
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def write_pages_json(pages: DataFrame, path: str) -> None:
    pages.drop("content_text").write.mode("overwrite").json(path)


def save_snapshots(snapshots: DataFrame, path: str, wait: float = 120) -> None:
    """Add rows of known columns below ``path``, all or none of them; other columns are dropped.

    A row without domain or date is an error, and so is a key that is there already or comes twice.  That holds among
    writers at the same time as well: rows are staged, and then compared with the table and renamed into it while
    holding a claim, a file that only one writer can create.  Others wait for up to ``wait`` seconds.  The claim of
    a writer that was killed is freed by :func:`release_claim`.  Object stores without exclusive creation and atomic
    renames do not give this.
    """
    spark = snapshots.sparkSession
    known = [f for f in SNAPSHOT.fields if f.name in snapshots.columns]
    rows = snapshots.select(*[F.col(f.name).cast(f.dataType) for f in known])
    for f in SNAPSHOT.fields:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    name = uuid.uuid4().hex
    staged = f"{path}/_staged/{name}"
    rows.select(*SNAPSHOT.names).write.partitionBy("domain").parquet(staged)
    key = ["domain", "crawl_date"]
    try:
        kept = spark.read.schema(SNAPSHOT).parquet(staged).select(*key)
        if kept.filter(F.col("domain").isNull() | F.col("crawl_date").isNull()).limit(1).count():
            raise ValueError("a snapshot needs domain and crawl_date")
        if kept.groupBy(*key).count().filter("count > 1").limit(1).count():
            raise ValueError("a snapshot comes twice")
        with _claimed(spark, path, name, wait):
            there = read_snapshots(spark, path).join(kept, key, "left_semi").select(*key).first()
            if there:
                raise ValueError(f"there is a snapshot of {there.domain} and {there.crawl_date}")
            fs, target = _at(spark, f"{path}/insert={name}")
            if kept.limit(1).count() and not fs.rename(_at(spark, staged)[1], target):
                raise OSError(f"{staged} could not be renamed")
    except BaseException:
        fs, target = _at(spark, staged)
        fs.delete(target, True)
        raise


@contextmanager
def _claimed(spark: SparkSession, path: str, owner: str, wait: float):
    """The claim on a table, while the body runs."""
    until, claim = time.monotonic() + wait, f"{path}/_claim"
    while not _create(spark, claim, owner):
        if time.monotonic() > until:
            raise TimeoutError(f"another writer has held {claim} for {wait} seconds")
        time.sleep(0.2)
    try:
        yield
    finally:
        release_claim(spark, path)


def release_claim(spark: SparkSession, path: str) -> bool:
    """Free the claim of a writer that was killed, and say whether there was one; no writer may be at work."""
    fs, target = _at(spark, f"{path}/_claim")
    return fs.delete(target, False)


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _create(spark: SparkSession, path: str, owner: str) -> bool:
    """Create a file that names its owner, unless there is one: of several that try, one succeeds."""
    fs, target = _at(spark, path)
    fs.mkdirs(target.getParent())
    jvm = spark._jvm
    if fs.getScheme() == "file":  # Hadoop's local file system looks first and creates then
        local = jvm.java.nio.file.Paths.get(target.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
        options = spark.sparkContext._gateway.new_array(jvm.java.nio.file.OpenOption, 2)
        options[0], options[1] = jvm.java.nio.file.StandardOpenOption.CREATE_NEW, jvm.java.nio.file.StandardOpenOption.WRITE
        make = lambda: jvm.java.nio.file.Files.newOutputStream(local, options)
    else:
        make = lambda: fs.create(target, False)
    try:
        stream = make()
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    stream.write(bytearray(owner.encode()))
    stream.close()
    return True


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All snapshots; none where there is no such folder yet."""
    fs, target = _at(spark, f"{path}/insert=*")
    if not fs.globStatus(target):
        return spark.createDataFrame([], SNAPSHOT)
    return spark.read.schema(SNAPSHOT).option("basePath", path).parquet(f"{path}/insert=*").select(*SNAPSHOT.names)


def history(snapshots: DataFrame, domain: str) -> DataFrame:
    """A domain's snapshots, oldest first."""
    return snapshots.filter(F.col("domain") == domain).orderBy("crawl_date")


def trend(snapshots: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Snapshots with the change of each metric since the one before."""
    w = Window.partitionBy("domain").orderBy("crawl_date")
    return snapshots.withColumns({f"{m}_change": F.col(m) - F.lag(m).over(w) for m in metrics})


def snapshot_row(pages: DataFrame, issues: DataFrame, domain: str, crawl_date: str) -> DataFrame:
    """The metrics row of a crawl; duplicate titles count once a title."""
    from ..operators.technical import duplicate_titles

    names = {"missing_title": "missing_titles", "missing_description": "missing_descriptions", "missing_h1": "missing_h1", "multiple_h1": "multiple_h1", "images_without_alt": "images_without_alt", "slow_page": "slow_pages", "thin_content": "thin_pages", "missing_canonical": "missing_canonical"}
    counted = issues.agg(F.countDistinct("url").alias("pages_with_issues"), *[F.count_if(F.col("issue_type") == k).alias(v) for k, v in names.items()], F.count_if(F.col("issue_type") != "duplicate_title").alias("_others"))
    titles = duplicate_titles(pages).agg(F.count(F.lit(1)).alias("duplicate_titles"))
    loads = pages.agg(F.count(F.lit(1)).alias("total_pages"), F.avg("load_time").alias("avg_load_time"))
    one = F.lit(1).alias("_k")
    joined = loads.select("*", one).join(counted.select("*", one), "_k").join(titles.select("*", one), "_k").drop("_k")
    return joined.withColumn("technical_issues", F.col("_others") + F.col("duplicate_titles")).drop("_others").withColumns({"domain": F.lit(domain), "crawl_date": F.lit(crawl_date).cast("timestamp_ntz")})
