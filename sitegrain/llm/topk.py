"""Exact top-k search by integer inner product, over vectors sorted by length.

Vectors are turned into the axes of their common singular value decomposition, where the first few coordinates hold
most of an inner product.  Candidates go by descending length in shards.  A query gets a threshold, its k-th best score
among the longest vectors; after that a shard is compared with a block of queries only if it holds vectors long enough
(|q| |c| >= threshold), and inside, block by block of candidates, with partial sums over the first axes: the rest of the
product is at most the product of the lengths of the two rests (Cauchy-Schwarz), and what cannot reach the
threshold is dropped.  What is left is scored in integers.  Rounding only ever weakens a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .prefix import in_slices, running

#: Candidates of a shard, queries of a block: what a task holds of each.
SHARD, QUERIES = 2048, 4096
#: The longest vectors, which all queries are compared with first; they go to every task.
HEAD = 1024
#: Candidates compared at once; the threshold rises between such steps.
STEP = 64
#: Leading components that are rotated; longer vectors keep the others as they are.
ROTATED = 512
_PAIRS = 16_384
_EXACT = float(1 << 53)


def integer_vectors(rows: DataFrame, vec_id: str, vector: str, scale: int = 256) -> DataFrame:
    """(n, vec_id, v, norm): components as floor(scale * x); ``n`` tells rows apart.

    Rows without an id or a vector, or with a null or non-finite component, take no part, nor do vectors so long
    (a length of 2 ** 31) that a score might not fit a long integer.  Empty vectors take part, with scores of 0.
    """
    x = F.col(vector).cast("array<double>")
    fits = F.aggregate(x, F.lit(0.0), lambda a, c: a + (F.abs(c * scale) + 1) * (F.abs(c * scale) + 1)) < float(1 << 62)
    kept = rows.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & fits)
    v = F.transform("x", lambda c: F.floor(c * scale).cast("long"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    return kept.select(F.monotonically_increasing_id().alias("n"), "vec_id", v.alias("v")).withColumn("norm", norm)


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as one matrix, filled with zeros where a vector is shorter."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def axes(vectors: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of all ``vectors``, from the sum of their outer products; width by width numbers."""
    d = min(width, ROTATED)

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            m = _matrix(b.column("v"), width)[:, :d].astype(float)
            total += m.T @ m
        yield pa.record_batch({"i": np.arange(d, dtype=np.int32), "r": pa.array(list(total), pa.list_(pa.float64()))})

    rows = vectors.select("v").mapInArrow(outer, "i int, r array<double>").select("i", F.posexplode("r").alias("j", "x"))
    cells = rows.groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()  # d * d numbers, however many vectors
    gram = np.zeros((d, d))
    gram[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["x"].to_numpy()
    turned = np.eye(width)
    if d:
        turned[:d, :d] = np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]
    return turned


class Search:
    """The k best candidates of a block of queries, fed with candidates by descending length."""

    def __init__(self, q_n: np.ndarray, q: np.ndarray, threshold: np.ndarray, k: int, turn: np.ndarray):
        self.n, self.q, self.k, self.turn = q_n, q, k, turn
        self.rotated, self.norm = q.astype(float) @ turn, np.linalg.norm(q.astype(float), axis=1)
        d = q.shape[1]
        self.cuts = sorted({max(1, d // 8), max(1, d // 4), max(1, d // 2)}) if d else []
        self.rests = [np.linalg.norm(self.rotated[:, c:], axis=1) for c in self.cuts]
        self.threshold = threshold.astype(float)
        self.best = tuple(np.empty(0, np.int64) for _ in range(3))  # query, candidate id, score
        self.scored = 0

    def add(self, c_n: np.ndarray, ids: np.ndarray, c: np.ndarray) -> None:
        rotated, norm = c.astype(float) @ self.turn, np.linalg.norm(c.astype(float), axis=1)
        rests = [np.linalg.norm(rotated[:, x:], axis=1) for x in self.cuts]
        for at in range(0, len(c), STEP):
            to = slice(at, at + STEP)
            slack = 1e-6 + 1e-9 * self.norm * norm[at]
            live = np.nonzero(self.norm * norm[at] >= self.threshold - slack)[0]
            if not len(live):
                return  # what follows is no longer
            floor = (self.threshold - slack)[live]
            if self.cuts:
                cut = self.cuts[0]
                near = self.rotated[live, :cut] @ rotated[to, :cut].T
                mask = near + np.outer(self.rests[0][live], rests[0][to]) >= floor[:, None]
            else:
                near, mask = None, np.ones((len(live), len(ids[to])), bool)
            mask &= self.n[live][:, None] != c_n[to][None, :]
            row, col = np.nonzero(mask)
            if mask.mean() > 0.25 and self.norm.max() * norm[at] < _EXACT:  # whole numbers below 2 ** 53 are exact
                scores = (self.q[live].astype(float) @ c[to].astype(float).T)[row, col].astype(np.int64)
                self.scored += len(row)
                self._keep(live[row], ids[to][col], scores)
                continue
            for part in range(0, len(row), _PAIRS):
                a, b = live[row[part : part + _PAIRS]], at + col[part : part + _PAIRS]
                so_far = near[row[part : part + _PAIRS], col[part : part + _PAIRS]] if near is not None else None
                for i in range(1, len(self.cuts)):
                    x, y = self.cuts[i - 1], self.cuts[i]
                    so_far = so_far + np.einsum("ij,ij->i", self.rotated[a, x:y], rotated[b, x:y])
                    keep = so_far + self.rests[i][a] * rests[i][b] >= self.threshold[a] - slack[a]
                    a, b, so_far = a[keep], b[keep], so_far[keep]
                self.scored += len(a)
                self._keep(a, ids[b], np.einsum("ij,ij->i", self.q[a], c[b]))

    def _keep(self, a: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.threshold[a]
        if not good.any():
            return
        a, ids, scores = (np.concatenate(x) for x in zip(self.best, (a[good], ids[good], scores[good])))
        order = np.lexsort((ids, -scores, a))
        a, ids, scores = a[order], ids[order], scores[order]
        first = np.searchsorted(a, a)
        rank = np.arange(len(a)) - first
        kept = rank < self.k
        full = rank == self.k - 1
        self.threshold[a[full]] = np.maximum(self.threshold[a[full]], scores[full])
        self.best = a[kept], ids[kept], scores[kept]


def _blocks(rows: DataFrame, order: list[str], size: int, name: str) -> DataFrame:
    """``rows`` with ``name``, the number of the run of ``size`` rows of ``order`` that holds each."""
    sliced = in_slices(rows, *order, tag=name)
    return materialize(running(sliced, [], order, rank=(F.sum, F.lit(1))).withColumn(name, F.floor((F.col("rank") - 1) / size).cast("long")).drop("rank", "slice"), name)


def top_k(rows: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, shard: int = SHARD, block: int = QUERIES, head: int = HEAD) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``queries`` (a condition on its id, as column vec_id) holds
    for, its ``k`` best other rows, ties to the smaller id; all, if there are fewer.

    Which rows take part: see :func:`integer_vectors`.  Vectors of unequal length are compared over the components
    that both have.  Rows that repeat an id are rows of their own, as queries and as candidates; an empty table gives
    no rows, and a lone row none; other columns are ignored.
    """
    vectors = materialize(integer_vectors(rows, vec_id, vector, scale).withColumn("shorter", -F.col("norm")), "vectors")
    width = vectors.agg(F.max(F.size("v"))).first()[0]
    schema = "query_n long, query_id long, vec_id long, score long"
    if width is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn = axes(vectors, width)
    longest = vectors.orderBy("shorter", "n").limit(head).select("n", "vec_id", "v").toArrow()
    top = (longest["n"].to_numpy(), longest["vec_id"].to_numpy(), _matrix(longest["v"], width))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            search = Search(b.column("n").to_numpy(), _matrix(b.column("v"), width), np.full(len(b), -np.inf), k, turn)
            search.add(*top)
            yield pa.record_batch([*b.columns, pa.array(search.threshold)], names=[*b.schema.names, "threshold"])

    asked = vectors.filter(queries).select("n", "vec_id", "v", "norm")
    known = asked.mapInArrow(first, "n long, vec_id long, v array<long>, norm double, threshold double")
    # the length that a candidate needs; queries that need like lengths share a block
    need = F.when((F.col("norm") > 0) & (F.col("threshold") > float("-inf")), F.col("threshold") / F.col("norm")).otherwise(F.lit(float("-inf")))
    placed = _blocks(known.withColumn("need", need), ["need", "n"], block, "block")
    shards = _blocks(vectors, ["shorter", "n"], shard, "shard")
    lengths = shards.groupBy("shard").agg(F.max("norm").alias("most"))
    last = shards.agg(F.max("shard")).first()[0]
    wanted = placed.groupBy("block").agg(F.min("need").alias("least")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last))))
    cells = materialize(wanted.join(lengths, "shard").filter(F.col("most") * (1 + 1e-9) + 1e-6 >= F.col("least")).select("block", "shard"), "cells")

    def search(key, left, right):
        right = right.sort_by([("shorter", "ascending"), ("n", "ascending")])
        found = Search(left["n"].to_numpy(), _matrix(left["v"], width), left["threshold"].to_numpy(), k, turn)
        found.add(right["n"].to_numpy(), right["vec_id"].to_numpy(), _matrix(right["v"], width))
        a, ids, scores = found.best
        return pa.table({"query_n": found.n[a], "query_id": left["vec_id"].to_numpy()[a], "vec_id": ids, "score": scores})

    ours = placed.join(cells, "block").select("block", "shard", "n", "vec_id", "v", "threshold")
    theirs = shards.join(cells, "shard").select("block", "shard", "n", "vec_id", "v", "shorter")
    pairs = ours.groupBy("block", "shard").cogroup(theirs.groupBy("block", "shard")).applyInArrow(search, schema)
    order = Window.partitionBy("query_n").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
