"""Sections of a report as independent jobs over one scan of the pages.

Every section is a function of the page table.  Sections run at the same time, each in a scheduler pool of its own
under a job tag, and write their tables below one folder.  One that fails, or is cancelled, takes nothing with it:
it leaves a row that says so.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shared import discard, written

STATUS = "section string, status string, error string, rows long"


class Sections:
    """``functions`` by name, over ``pages``; tables go to ``path``/name.  At most ``at_once`` run together."""

    def __init__(self, pages: DataFrame, functions: dict[str, Callable[[DataFrame], DataFrame]], path: str, at_once: int = 4):
        self.spark, self.path, self.functions = pages.sparkSession, path.rstrip("/"), functions
        self.run, self.at_once, self.pages, self.cancelled = uuid.uuid4().hex, at_once, pages, set()

    def tag(self, name: str) -> str:
        """The tag of a section's jobs; names may hold anything."""
        return f"{self.run}-{sorted(self.functions).index(name)}"

    def cancel(self, name: str) -> None:
        """Stop a section, now or before it begins."""
        self.cancelled.add(name)
        self.spark.sparkContext.cancelJobsWithTag(self.tag(name))

    def _one(self, name: str, shared: DataFrame) -> tuple:
        context = self.spark.sparkContext
        context.setLocalProperty("spark.scheduler.pool", name)
        context.addJobTag(self.tag(name))
        try:
            if name in self.cancelled:
                return name, "cancelled", None, None
            seen = Observation()
            table = self.functions[name](shared).observe(seen, F.count(F.lit(1)).alias("rows"))
            table.write.mode("overwrite").parquet(f"{self.path}/{name}")
            return name, "ok", None, seen.get["rows"]
        except Exception as e:  # whatever a section raises is its own
            if name in self.cancelled:
                return name, "cancelled", None, None
            return name, "failed", error_class(e), None
        finally:
            context.removeJobTag(self.tag(name))
            context.setLocalProperty("spark.scheduler.pool", None)

    def results(self) -> DataFrame:
        """Run all sections and give a row each: ok, failed or cancelled, the error's class, and the rows written."""
        shared = written(self.pages, "shared")
        with ThreadPoolExecutor(self.at_once) as pool:
            jobs = [pool.submit(inheritable_thread_target(self.spark)(self._one), name, shared) for name in self.functions]
            rows = [job.result() for job in jobs]
        discard(shared)
        return self.spark.createDataFrame(rows, STATUS)

    def read(self, name: str) -> DataFrame:
        """The table of a section that succeeded."""
        return self.spark.read.parquet(f"{self.path}/{name}")


def error_class(e: BaseException) -> str:
    """Spark's condition where there is one, else the type's name."""
    found = e.getCondition() if isinstance(e, PySparkException) else None
    return found or type(e).__name__
