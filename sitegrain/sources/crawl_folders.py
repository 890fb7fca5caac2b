"""Crawl folders as a Spark data source: ``root/domain/crawl_ts/part/files``.

A part is what a crawl keeps beside the others: ``pages``, ``lighthouse`` reports, ``analysis-...`` tables.  Files
ending in ``.json`` hold one document each, whoever wrote them, and the file's stem is its page; what this module
writes are files of many documents, ``part-*.lines``, a page and a JSON text a line.  Those count only if a manifest
names them, and manifests are put in place when all tasks of a write are done, so that a crawl is there whole or not
at all, whatever becomes of the write.

Filters on ``domain`` and ``crawl_ts`` are pushed down: folders that they rule out are not listed, let alone opened.
Typed columns are made from the JSON text in the JVM.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from ..schema import PAGE
from . import lighthouse

NAME = "sitegrain_crawl"
SCHEMA = "domain string, crawl_ts string, page_id string, value string"
#: Files that one task reads, about; documents of a batch; files that a task holds open.
FILES, BATCH, OPEN = 256, 500, 32
_TESTS = {
    EqualTo: lambda f, x: x == f.value,
    EqualNullSafe: lambda f, x: x == f.value,
    In: lambda f, x: x in f.value,
    GreaterThan: lambda f, x: x > f.value,
    GreaterThanOrEqual: lambda f, x: x >= f.value,
    LessThan: lambda f, x: x < f.value,
    LessThanOrEqual: lambda f, x: x <= f.value,
    StringStartsWith: lambda f, x: x.startswith(f.value),
    IsNotNull: lambda f, x: True,
}


def _store(path: str):
    """(filesystem, path) of pyarrow for a path or URI."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _entries(store, path: str, folders: bool) -> list[str]:
    """Base names of the folders, or the files, of a folder, in order; none where there is no such folder."""
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(i.base_name for i in found if (i.type == fs.FileType.Directory) == folders)


def documents_of(store, folder: str) -> list[str]:
    """Files of a part that count: single documents, and those that manifests name."""
    names = _entries(store, folder, False)
    named = set()
    for name in names:
        if name.startswith("_manifest-") and name.endswith(".json"):
            with store.open_input_stream(f"{folder}/{name}") as f:
                named |= set(json.loads(f.read())["files"])
    return sorted(named | {n for n in names if n.endswith(".json") and not n.startswith(("_", ".", "part-"))})


@dataclass
class Piece(InputPartition):
    """Some files of one crawl."""

    domain: str
    crawl_ts: str
    files: tuple[str, ...]


class CrawlReader(DataSourceReader):
    def __init__(self, path: str, part: str):
        self.path, self.part, self.pushed = path, part, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("domain",), ("crawl_ts",)) and (not hasattr(f, "value") or f.value is not None):
                self.pushed.append(f)
            else:
                yield f

    def _wanted(self, column: str, value: str) -> bool:
        return all(_TESTS[type(f)](f, value) for f in self.pushed if f.attribute == (column,))

    def partitions(self) -> list[Piece]:
        store, root = _store(self.path)
        found = []
        for domain in filter(lambda d: d[0] not in "._" and self._wanted("domain", d), _entries(store, root, True)):
            for ts in filter(lambda t: t[0] not in "._" and self._wanted("crawl_ts", t), _entries(store, f"{root}/{domain}", True)):
                folder = f"{root}/{domain}/{ts}/{self.part}"
                files = [f"{folder}/{n}" for n in documents_of(store, folder)]
                found += [Piece(domain, ts, tuple(files[i : i + FILES])) for i in range(0, len(files), FILES)]
        return found or [Piece("", "", ())]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        rows: list[tuple[str, str]] = []

        def batch():
            ids, values = zip(*rows)
            n = len(rows)
            rows.clear()
            return pa.record_batch({"domain": pa.array([piece.domain] * n), "crawl_ts": pa.array([piece.crawl_ts] * n), "page_id": pa.array(ids, pa.string()), "value": pa.array(values, pa.string())})

        for name in piece.files:
            with store.open_input_stream(name) as f:
                if name.endswith(".json"):
                    rows.append((re.sub(r"\.json$", "", name.rsplit("/", 1)[-1]), f.read().decode("utf-8", "replace")))
                else:
                    for line in _lines(f):
                        page, _, value = line.decode("utf-8", "replace").partition("\t")
                        rows.append((page or None, value))
                        if len(rows) >= BATCH:
                            yield batch()
            if len(rows) >= BATCH:
                yield batch()
        if rows:
            yield batch()


def _lines(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The lines of a stream that is read piece by piece."""
    rest = b""
    while chunk := stream.read(size):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str, str]]


class CrawlWriter(DataSourceArrowWriter):
    """Every task writes files of its own; the commit names them in a manifest a crawl, an abort removes them."""

    def __init__(self, path: str, part: str, replace: bool):
        self.path, self.part, self.replace, self.job = path, part, replace, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        opened: OrderedDict = OrderedDict()
        files: list[tuple[str, str, str]] = []
        try:
            for b in batches:
                for domain, ts, page, value in zip(*(b.column(c).to_pylist() for c in ("domain", "crawl_ts", "page_id", "value"))):
                    if not all(x and x[0] not in "._" and not re.search(r"[/\\]", x) for x in (domain, ts)):
                        raise ValueError(f"no folder can be named {domain!r}/{ts!r}")
                    if (domain, ts) not in opened:
                        if len(opened) >= OPEN:
                            opened.popitem(last=False)[1].close()
                        folder, name = f"{root}/{domain}/{ts}/{self.part}", f"part-{self.job}-{uuid.uuid4().hex}.lines"
                        store.create_dir(folder, recursive=True)
                        opened[domain, ts] = store.open_output_stream(f"{folder}/{name}")
                        files.append((domain, ts, name))
                    opened[domain, ts].write((re.sub(r"[\t\r\n]", " ", page or "") + "\t" + re.sub(r"[\r\n]+", " ", value or "null") + "\n").encode())
        finally:
            for f in opened.values():
                f.close()
        return Written(files)

    def _by_crawl(self, messages: list) -> dict[str, list[str]]:
        _, root = _store(self.path)
        found: dict[str, list[str]] = {}
        for m in filter(None, messages):
            for domain, ts, name in m.files:
                found.setdefault(f"{root}/{domain}/{ts}/{self.part}", []).append(name)
        return found

    def commit(self, messages: list) -> None:
        store, _ = _store(self.path)
        for folder, names in self._by_crawl(messages).items():
            before = [n for n in _entries(store, folder, False) if n.startswith("_manifest-")] if self.replace else []
            old = documents_of(store, folder) if self.replace else []
            with store.open_output_stream(f"{folder}/.{self.job}") as f:
                f.write(json.dumps({"files": sorted(names)}).encode())
            store.move(f"{folder}/.{self.job}", f"{folder}/_manifest-{self.job}.json")
            for name in [*before, *old]:
                store.delete_file(f"{folder}/{name}")

    def abort(self, messages: list) -> None:
        store, _ = _store(self.path)
        for folder, names in self._by_crawl(messages).items():
            for name in names:
                store.delete_file(f"{folder}/{name}")


class CrawlSource(DataSource):
    """Options: ``path``, and ``part``, by default ``pages``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, str]:
        if not self.options.get("path"):
            raise ValueError("a path is needed")
        return self.options["path"].rstrip("/"), self.options.get("part", "pages")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return CrawlReader(*self._options())

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return CrawlWriter(*self._options(), overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let it see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CrawlSource)


def scan(spark: SparkSession, path: str, part: str = "pages") -> DataFrame:
    """(domain, crawl_ts, page_id, value) of all crawls below ``path``; value is the JSON text."""
    register(spark)
    return spark.read.format(NAME).option("part", part).load(path)


def store(rows: DataFrame, path: str, domain: str | None, crawl_ts: str | None, part: str, replace: bool = False) -> None:
    """Write ``rows`` (page_id, value) as a part of a crawl; of several, where ``rows`` have domain and crawl_ts themselves."""
    register(rows.sparkSession)
    fixed = {k: F.lit(v) for k, v in (("domain", domain), ("crawl_ts", crawl_ts)) if v is not None}
    named = rows.withColumns(fixed) if fixed else rows
    named.select("domain", "crawl_ts", F.col("page_id").cast("string").alias("page_id"), F.col("value").cast("string").alias("value")).write.format(NAME).option("part", part).mode("overwrite" if replace else "append").save(path)


#: A stored page has the length of its text in place of the text.
STORED = T.StructType([*(f for f in PAGE.fields if f.name != "content_text"), T.StructField("content_length", T.IntegerType())])


def write_pages(pages: DataFrame, path: str, domain: str | None = None, crawl_ts: str | None = None, replace: bool = False) -> None:
    """Pages of a crawl, known columns only; ``pages`` may name domain and crawl_ts themselves."""
    kept = pages.withColumn("content_length", F.length("content_text")) if "content_text" in pages.columns else pages
    known = [f.name for f in STORED.fields if f.name in kept.columns]
    names = [c for c in ("domain", "crawl_ts") if c in pages.columns]
    store(kept.select(*names, F.sha2(F.coalesce("url", F.lit("")), 256).substr(1, 16).alias("page_id"), F.to_json(F.struct(*known)).alias("value")), path, domain, crawl_ts, "pages", replace)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of all crawls, with domain and crawl_ts; documents that are no page objects are skipped."""
    rows = scan(spark, path).withColumn("p", F.from_json("value", STORED, {"mode": "PERMISSIVE"}))
    return rows.filter("p.url is not null").select("p.*", "domain", "crawl_ts")


def write_reports(reports: DataFrame, path: str, domain: str | None = None, crawl_ts: str | None = None) -> None:
    """Laboratory reports (page_id, report as JSON text) of a crawl."""
    store(reports.withColumnRenamed("report", "value"), path, domain, crawl_ts, "lighthouse")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(domain, crawl_ts, page_id, report): parsed reports of all crawls, for :mod:`.lighthouse`; others are skipped."""
    return lighthouse.parse(scan(spark, path, "lighthouse"), "value")


def write_analysis(sections: dict[str, DataFrame], path: str, domain: str, crawl_ts: str) -> None:
    """Every section of an analysis, as a part of its own; a section written again replaces itself."""
    for name, table in sections.items():
        rows = table.select(F.lit(None).cast("string").alias("page_id"), F.to_json(F.struct(*table.columns)).alias("value"))
        store(rows, path, domain, crawl_ts, f"analysis-{name}", replace=True)


def read_analysis(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A section of all crawls, with domain and crawl_ts."""
    rows = scan(spark, path, f"analysis-{name}").withColumn("s", F.from_json("value", schema))
    return rows.select("domain", "crawl_ts", "s.*")
