"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The session's setting that names the folder of the run in progress.
RUN = "sitegrain.run"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only in local mode, where the session names none, a temporary one is made and kept in the session; a cluster
    without a shared folder is an error, for each executor would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sitegrain-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str, kept: bool = False) -> str:
    """A fresh path below the shared folder; inside :func:`scratch_run` it goes with the run, unless ``kept``."""
    run = None if kept else spark.conf.get(RUN, None)
    return "/".join([shared_dir(spark), "sitegrain-tables", *([run] if run else []), f"{tag}-{uuid.uuid4().hex}"])


@contextmanager
def scratch_run(spark: SparkSession):
    """Within it, the tables of :func:`written` lie in a folder of their own, which is removed at its end, also where
    the run fails.  What a run returns must be written elsewhere (``scratch_path(kept=True)``) before it ends.

    Runs nest, the inner one's folder inside the outer one's.  The folder is a setting of the session, so runs that
    overlap in time need sessions of their own (``spark.newSession()``).
    """
    outer = spark.conf.get(RUN, None)
    name = "/".join([*([outer] if outer else []), f"run-{uuid.uuid4().hex}"])
    spark.conf.set(RUN, name)
    try:
        yield
    finally:
        if outer:
            spark.conf.set(RUN, outer)
        else:
            spark.conf.unset(RUN)
        _remove(spark, f"{shared_dir(spark)}/sitegrain-tables/{name}")


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """``df`` as a table of the shared folder: made once, however many branches read it, and safe from lost executors.

    It cuts the lineage, and values that are not reproducible (row numbers) are fixed.
    """
    path = path or scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Bound what one Arrow batch holds, so that very long texts do not fill a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def discard(df: DataFrame) -> None:
    """Remove a table made by :func:`written` that no later plan reads."""
    path = getattr(df, "_scratch", None)
    if path:
        _remove(df.sparkSession, path)
