"""Progress of streaming queries as a table: a row for every micro-batch, written by a listener."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources.crawl_folders import _entries, _store

SCHEMA = "query string, name string, batch long, at string, input_rows long, done long, failed long, last string"
METRICS = "progress"


def watched(rows: DataFrame, order: str, url: str, failed: Column | None = None) -> DataFrame:
    """``rows`` with metrics that are gathered while they pass: how many, how many failed, and the last url by ``order``."""
    bad = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    return rows.observe(METRICS, F.count(F.lit(1)).alias("done"), F.count_if(bad).alias("failed"), F.max(F.struct(order, url)).alias("last"))


class ProgressTable(StreamingQueryListener):
    """Writes a file a micro-batch below ``path``, named by query and batch, so that a batch that runs again replaces its row.

    Queries not in ``names``, where given, are passed over.  Batches without metrics of :func:`watched` have nulls.
    """

    def __init__(self, path: str, names: tuple[str, ...] | None = None):
        self.path, self.names = path.rstrip("/"), names

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.names is not None and p.name not in self.names:
            return
        metrics = p.observedMetrics.get(METRICS)
        row = {"query": str(p.id), "name": p.name, "batch": p.batchId, "at": p.timestamp, "input_rows": p.numInputRows}
        if metrics is not None:
            last = metrics["last"]
            row |= {"done": metrics["done"], "failed": metrics["failed"], "last": None if last is None else last[1]}
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/.{p.id}-{p.batchId}") as f:
            f.write((json.dumps(row) + "\n").encode())
        store.move(f"{root}/.{p.id}-{p.batchId}", f"{root}/{p.id}-{p.batchId}.json")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The rows so far, with running totals by query: ``total`` rows done up to each batch; none where nothing is written yet."""
    store, root = _store(path.rstrip("/"))
    if not any(n.endswith(".json") for n in _entries(store, root, False)):
        return spark.createDataFrame([], SCHEMA + ", total long")
    from pyspark.sql import Window

    batches = Window.partitionBy("query").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return spark.read.schema(SCHEMA).json(f"{path}/*.json").withColumn("total", F.sum("done").over(batches))
