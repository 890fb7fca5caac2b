"""Lists that a crawl is set up with: proxies and test addresses, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a proxy has that does not say.
PROXY_KIND, PROXY_PORT = "http", 8080
_ADDRESS = r"^([a-z0-9+.-]+)://(?:([^:@/]*)(?::([^@/]*))?@)?([^:/@]+)(?::([0-9]+))?"


def proxies(lines: DataFrame, column: str = "value") -> DataFrame:
    """(host, port, kind, username, password) of lines ``kind://user:password@host:port`` or
    ``host,port,kind,username,password``; blank lines, comments and other lines are left out."""
    rows = lines.select(F.trim(F.col(column)).alias("l")).filter((F.col("l") != "") & ~F.startswith("l", F.lit("#")))
    part = lambda k: F.nullif(F.regexp_extract("l", _ADDRESS, k), F.lit(""))
    whole = F.struct(part(4).alias("host"), F.coalesce(part(5).try_cast("int"), F.lit(PROXY_PORT)).alias("port"), F.coalesce(part(1), F.lit(PROXY_KIND)).alias("kind"), part(2).alias("username"), part(3).alias("password"))
    cells = F.split("l", ",")
    cell = lambda k: F.nullif(F.trim(F.get(cells, F.lit(k))), F.lit(""))
    parted = F.struct(cell(0).alias("host"), cell(1).try_cast("int").alias("port"), F.coalesce(cell(2), F.lit(PROXY_KIND)).alias("kind"), cell(3).alias("username"), cell(4).alias("password"))
    found = rows.select(F.when(F.contains("l", F.lit("://")), whole).when(F.contains("l", F.lit(",")), parted).alias("p")).select("p.*")
    return found.filter(F.col("host").isNotNull() & F.col("port").isNotNull())


def addresses(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name, value) of an address file: ``defaults`` by name, and the entries of lists such as ``serviceable``
    as address, city, zip and unit, numbered.  Of YAML it reads what such files have: two levels, scalars only."""
    lines = spark.read.text(path).withColumn("no", F.monotonically_increasing_id()).collect()  # a file of a few lines
    rows, section, entry = [], "", -1
    for line in sorted(lines, key=lambda r: r.no):
        text = line.value.split(" #")[0].rstrip()
        if not text.strip() or text.lstrip().startswith("#"):
            continue
        name, _, value = text.strip().removeprefix("- ").partition(":")
        value = value.strip().strip("\"'")
        if not text.startswith((" ", "-")):
            section, entry = name, -1
            continue
        entry += text.lstrip().startswith("- ")
        if value:
            rows.append((section if entry < 0 else f"{section}[{entry}]", name.strip(), value))
    return spark.createDataFrame(rows, "kind string, name string, value string")
