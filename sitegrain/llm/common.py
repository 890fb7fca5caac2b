"""Shared helpers: the shared scratch folder, materialised tables, file access from executors."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import bounded_batches, discard, scratch_path, scratch_run, shared_dir  # noqa: F401  for the operators
from ..sources.shared import written as materialize  # noqa: F401

#: Words are maximal runs outside ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with, for helper columns beside its own."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, everything else untouched."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 modulo 4; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(rows: DataFrame, key: str | list[str], limit: int) -> DataFrame:
    """About ``limit`` rows chosen by a hash of ``key``; all rows where there are no more than that."""
    key = [key] if isinstance(key, str) else key
    n = rows.select(*key).count()
    if n <= limit:
        return rows
    return rows.filter(F.shiftrightunsigned(F.xxhash64(*key), 1) < F.lit((limit << 63) // n).cast("long"))


def open_output(path: str):
    """(filesystem, path) of pyarrow for a URI of the shared folder."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_atomically(path: str, write) -> None:
    """Call ``write(sink)``, then move the file into place; a repeated attempt replaces it whole."""
    store, name = open_output(path)
    store.create_dir(os.path.dirname(name), recursive=True)
    temporary = f"{name}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(temporary) as sink:
        write(sink)
    store.move(temporary, name)
