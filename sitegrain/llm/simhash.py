"""SimHash fingerprints and exact near-duplicate links between them by vantage-point trees.

Method.  A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles.  Two fingerprints
link when their Hamming distance is at most ``radius``.

At the top, a vantage-point tree of ``LEVELS`` levels over all fingerprints: every node takes a fingerprint as its
point and the median distance to it as its radius, the inner child gets what lies within the median or up to ``radius``
beyond it, the outer child what lies outside.  So a pair across the boundary meets in the inner child, which is
queried with the boundary's overlap.  For random fingerprints, whose distances to any point are 32 +- 4, the overlap
copies about 1.4 times as many fingerprints at every level, 1.4 ** n over n levels; so the tree over everything stays
shallow, and its shards are divided further in projected spaces, where the overlap copies nothing: the 64 bits are cut
into blocks, and a shard holds the fingerprints that agree on ``blocks - radius`` of them, that is, whose distance to a
vantage point in that projection is zero.  Any two fingerprints within the radius differ in at most ``radius`` blocks,
so some shard holds both.  There are 5 projections up to about 14 million distinct fingerprints a top shard, then 15, 35
and 70.  Inside a shard a vantage-point tree over the full Hamming distance splits at the median distance, prunes by
triangle bounds, and compares the two sides only where they lie within the radius of the boundary.

Every task returns a spanning forest of its links, not the links themselves, so output is linear in its input
however dense a group is.  Shards above ``shard_limit`` fingerprints are divided again by the bits that their
projection leaves free, and what stays above it is cut into chunks, of which every pair is a task of its own: nothing
is dropped and no task holds an unbounded group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, free_prefix, materialize
from .graph import connected_components

SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LEAF = 48
#: Levels of the vantage-point tree over all fingerprints.
LEVELS = 3


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned 64-bit fingerprint of one text; 0 for a text without words, or null."""
    if not text:
        return 0
    tokens = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(tokens) - words] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    ends = ends[words - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for k in range(0, len(starts), 65536):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[k : k + 65536], ends[k : k + 65536])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp long) for every row of ``docs``; null texts have fingerprint 0."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


def block_masks(radius: int, blocks: int) -> list[int]:
    """One mask for each choice of ``blocks - radius`` of the blocks, as signed 64-bit integers."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, others) -> None:
        for j in others:
            a, b = self.find(i), self.find(j)
            if a != b:
                self.parent[max(a, b)] = min(a, b)


def near_forest(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the links between distinct ``points`` (uint64)."""
    forest = _Forest(len(points))

    def compare(a, b=None):
        """All of ``a`` against ``b``, or against itself, a bounded matrix at a time."""
        other = a if b is None else b
        step = max(1, 1_000_000 // max(1, len(other)))
        for k in range(0, len(a), step):
            rows = a[k : k + step]
            i, j = np.nonzero(np.bitwise_count(points[rows][:, None] ^ points[other][None, :]) <= radius)
            if b is None:
                keep = rows[i] < other[j]
                i, j = i[keep], j[keep]
            if len(i):
                cuts = np.flatnonzero(np.diff(i)) + 1
                for group_i, group_j in zip(np.split(i, cuts), np.split(j, cuts)):
                    forest.join(int(rows[group_i[0]]), other[group_j].tolist())

    stack = [np.arange(len(points))]
    while stack:
        part = stack.pop()
        if len(part) <= _LEAF:
            if len(part) > 1:
                compare(part)
            continue
        d = np.bitwise_count(points[part] ^ points[part[0]]).astype(np.int16)
        median = int(np.median(d))
        near = d <= median
        if near.all():
            median, near = int(d.max()) - 1, d < d.max()
        if not near.any():  # one distance only: the vantage point is the only point
            compare(part)
            continue
        inside, outside, di, do = part[near], part[~near], d[near], d[~near]
        for ring in range(median + 1, median + radius + 1):  # triangle bound: |d(x, p) - d(y, p)| <= d(x, y)
            y, x = outside[do == ring], inside[di >= ring - radius]
            if len(x) and len(y):
                compare(y, x)
        stack += [inside, outside]
    return [(i, root) for i in range(len(points)) if (root := forest.find(i)) != i]


def free_masks(radius: int, mask: int) -> list[int]:
    """The bits outside ``mask`` in ``radius`` + 1 parts, as signed 64-bit integers."""
    free = [b for b in range(64) if not mask >> b & 1]
    edges = [round(len(free) * k / (radius + 1)) for k in range(radius + 2)]
    parts = [sum(1 << b for b in free[a:b]) for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in parts]


def _with_size(rows: DataFrame, leaf: list[str], limit: int) -> DataFrame:
    """``rows`` with ``n``, the size of their leaf where that is above ``limit``."""
    return rows.join(rows.groupBy(*leaf).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit), leaf, "left")


def shards(placed: DataFrame, radius: int, blocks: int, shard_limit: int) -> DataFrame:
    """(key, fp): every two fingerprints of a leaf of ``placed`` (path, fp) within ``radius`` share a key.

    A key is a leaf of a projection.  Where more than ``shard_limit`` fingerprints share one, they are divided again
    by ``radius`` + 1 parts of the bits that the projection leaves free, of which two within the radius agree on one;
    what is above the limit even then (fingerprints alike in nearly all bits) is cut into chunks that meet in pairs.
    """
    masks = block_masks(radius, blocks)
    leaf = ["path", "space", "leaf"]
    shard = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("space", "leaf")
    sized = _with_size(placed.select("path", "fp", shard), leaf, shard_limit)
    whole = sized.filter("n IS NULL").select(F.xxhash64(*leaf).alias("key"), "fp")
    parts = F.array(*[F.array(*[F.lit(m).cast("long") for m in free_masks(radius, mask)]) for mask in masks])
    finer = sized.filter("n IS NOT NULL").select(*leaf, "fp", F.posexplode(parts[F.col("space")]).alias("part", "mask"))
    again = _with_size(finer.withColumn("inner", F.col("fp").bitwiseAND(F.col("mask"))), [*leaf, "part", "inner"], shard_limit)
    chunks = F.ceil(F.col("n") / shard_limit).cast("int")
    own = F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), chunks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda k: F.least(k, own) * 1_000_000 + F.greatest(k, own))
    chunked = F.explode(F.when(F.col("n").isNull(), F.array(F.lit(-1))).otherwise(pairs)).alias("chunk")
    met = again.select(*leaf, "part", "inner", "fp", chunked).select(F.xxhash64(*leaf, "part", "inner", "chunk").alias("key"), "fp")
    return whole.unionAll(met)


def vantage_shards(distinct: DataFrame, radius: int, levels: int = LEVELS) -> DataFrame:
    """(path, fp): the ``distinct`` fingerprints (column fp) by the leaves of the top tree that they belong to.

    Any two fingerprints within ``radius`` share a leaf.  Only a point and a median a node go through the driver's
    broadcasts, 2 ** level rows.
    """
    placed = distinct.select("fp", F.lit(0).alias("path"))
    for level in range(levels):
        points = placed.groupBy("path").agg(F.min_by("fp", F.xxhash64("fp", F.lit(level))).alias("point"))
        measured = placed.join(F.broadcast(points), "path").select("path", "fp", F.bit_count(F.col("fp").bitwiseXOR(F.col("point"))).alias("d"))
        middles = measured.groupBy("path").agg((F.percentile_approx("d", 0.5) - radius // 2).alias("middle"))
        sides = F.array(F.when(F.col("d") <= F.col("middle") + radius, F.col("path") * 2), F.when(F.col("d") > F.col("middle"), F.col("path") * 2 + 1))
        below = materialize(measured.join(F.broadcast(middles), "path").select("fp", F.explode(F.array_compact(sides)).alias("path")), "vantage")
        discard(placed)
        placed = below
    return placed


def links(distinct: DataFrame, radius: int = 4, blocks: int | None = None, shard_limit: int = 4096) -> DataFrame:
    """Edges (u, v) that connect every two of the ``distinct`` fingerprints (column fp) within ``radius``.

    They are a spanning forest of each shard's links: the same components, at most one edge a fingerprint and shard.
    """
    if blocks is None:  # about a thousand fingerprints a shard, as far as four more blocks go
        n, blocks = distinct.count() / 2**LEVELS, radius + 1
        while blocks < radius + 4 and n / 2 ** (64 * (blocks - radius) / blocks) > 2000:
            blocks += 1
    keyed = shards(vantage_shards(distinct, radius), radius, blocks, shard_limit).repartition("key").sortWithinPartitions("key")

    def run(batches):
        held_key, held = None, []

        def forest(key_points):
            points = np.unique(np.concatenate(key_points))
            found = near_forest(points, radius) if len(points) > 1 else []
            return [points[i] for i, _ in found], [points[j] for _, j in found]

        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            u, v = [], []
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if b <= a:
                    continue
                if held_key != key[a] and held:
                    if sum(map(len, held)) > 1:
                        x, y = forest(held)
                        u += x
                        v += y
                    held = []
                held_key = key[a]
                held.append(fp[a:b])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(u, np.uint64).view(np.int64)), pa.array(np.array(v, np.uint64).view(np.int64))], ["u", "v"])
        if sum(map(len, held)) > 1:
            u, v = forest(held)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(u, np.uint64).view(np.int64)), pa.array(np.array(v, np.uint64).view(np.int64))], ["u", "v"])

    return keyed.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, shard_limit: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius`` differing bits, the row's own
    included.  Defined cases: null and empty texts, and texts without words, have fingerprint 0 and are linked like
    any other; rows with one doc_id twice give two rows; null ids get the smallest non-null id of their component,
    or null; an empty table gives no rows; further columns are ignored.
    """
    own = materialize(fingerprints(docs, words), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(links(distinct.select("fp"), radius, shard_limit=shard_limit))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # written, so that the join can split the fingerprints of a hot component
    smallest = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "components")
    by_fp = named.join(smallest, "component").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (rows without one come last), and of
    rows that share it the one whose text has the smallest hash; rows that repeat id and text count as one.

    Texts are shuffled once, on the pair of hashes that both the join and the deduplication go by.
    """
    content = ("doc_id", F.col("text").cast("string"))
    h, g = (free_prefix(docs) + x for x in "hg")
    keyed = docs.withColumns({h: F.xxhash64(*content), g: F.xxhash64(F.lit(1), *content)})
    ids = keyed.select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col(h).alias("h"), F.col(g).alias("g")).alias("doc_id"), "text")
    kept = near_duplicates(ids, **options).filter("doc_id = component_id").select(F.col("doc_id.h").alias(h), F.col("doc_id.g").alias(g)).distinct()
    return keyed.join(kept, [h, g], "left_semi").dropDuplicates([h, g]).select(*docs.columns)
