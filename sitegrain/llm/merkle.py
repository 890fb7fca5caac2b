"""Merkle manifest of a table: leaves by language, their roots under one root, and a proof for every row.

Nodes are numbered by distributed ranks and cut into aligned blocks of ``FAN ** DEPTH``.  A first pass folds each block
with a treehash stack into its root, and the roots into blocks of their own, until one node a group is left.  A second
pass goes through each block leaf by leaf: its authentication path is kept as one run of siblings a level, and a
treehash stack a level gathers the next run from the leaves ahead, one leaf a step, so that it is ready when the path
needs it.  What lies above a block is the same for all its leaves and is appended.  Paths never leave their task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lower_ascii, materialize
from .prefix import in_slices, running

FAN = 8
#: Levels of a block: 512 leaves.
DEPTH = 3
SIZE = FAN**DEPTH


def digest(parts) -> str:
    """H: lower-case hex SHA-256 of the parts in a row."""
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*columns: Column) -> Column:
    """H of the columns, each ``-`` where null, else its UTF-8 byte count, a colon and its value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


class Treehash:
    """A stack that folds nodes into those ``height`` levels up, ``FAN`` into one as soon as they are complete."""

    def __init__(self, height: int):
        self.levels = [[] for _ in range(height)]
        self.done: list[str] = []

    def push(self, node: str) -> None:
        for level in self.levels:
            level.append(node)
            if len(level) < FAN:
                return
            node = digest(level)
            level.clear()
        self.done.append(node)

    def finish(self) -> list[str]:
        """Fold what is left of the last runs, and give the nodes of the top level."""
        for level, above in zip(self.levels, [*self.levels[1:], self.done]):
            if level:
                above.append(digest(level))
                level.clear()
        return self.done


def height(nodes: int) -> int:
    """Levels above ``nodes`` that stand alone."""
    n = 0
    while nodes > 1:
        nodes, n = -(-nodes // FAN), n + 1
    return n


def fold(nodes, levels: int) -> str:
    """The root of at most ``FAN ** levels`` nodes, ``levels`` up."""
    stack = Treehash(levels)
    for node in nodes:
        stack.push(node)
    (root,) = stack.finish()
    return root


def paths(nodes, levels: int) -> Iterator[list[tuple[list[str], list[str]]]]:
    """For every node of a block, the siblings to its left and right at each of ``levels`` levels.

    Beside ``nodes`` it holds a run a level, the next run as far as it is gathered, and a stack a level.
    """
    n, runs, ahead = len(nodes), [], []
    for level in range(levels):  # the first run of each level; its successor is gathered from the leaves behind it
        stack = Treehash(level)
        for node in nodes[: FAN ** (level + 1)]:
            stack.push(node)
        runs.append(stack.finish())
        ahead.append(Treehash(level))
    for i in range(n):
        for level in range(levels):
            width = FAN ** (level + 1)
            if i and i % width == 0:
                runs[level], ahead[level] = ahead[level].finish(), Treehash(level)
            if i + width < n:
                ahead[level].push(nodes[i + width])
        at = [i // FAN**level % FAN for level in range(levels)]
        yield [(runs[level][:k], runs[level][k + 1 :]) for level, k in enumerate(at)]


def climb(node: str, path) -> str:
    """The root that a node and the siblings of its path give."""
    for left, right in path:
        node = digest([*left, node, *right])
    return node


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, their place from 0 in ``order`` within ``by``, ``block``, and ``total``, the rows of their ``by``."""
    sliced = in_slices(rows.withColumn("_tie", F.monotonically_increasing_id()), *by, *order, "_tie", tag="nodes")
    ranked = running(sliced, by, [*order, "_tie"], n=(F.sum, F.lit(1))).withColumn("idx", F.col("n") - 1).drop("n", "_tie")
    # totals go with the slices, so that a large group is no key of a join
    parts = sliced.groupBy("slice", *by).agg(F.count(F.lit(1)).alias("rows"))
    totals = parts.select("slice", *by, F.sum("rows").over(Window.partitionBy(*by)).alias("total"))
    out = materialize(ranked.join(totals, ["slice", *by]).drop("slice").withColumn("block", _block(F.col("idx"))), "numbered")
    discard(sliced)
    return out


def _block(idx: Column) -> Column:
    return F.floor(idx / SIZE).cast("long")


def _levels(total: int) -> int:
    return DEPTH if total > SIZE else height(total)


_LINK = "array<struct<left:array<string>,right:array<string>>>"
_LINKS = pa.list_(pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))


def _linked(nodes: pa.Table, rest: list) -> pa.Array:
    """The paths of all nodes of a block, as far as it goes and ``rest`` beyond it."""
    found = paths(nodes["node"].to_pylist(), _levels(nodes["total"][0].as_py()))
    return pa.array([[*({"left": a, "right": b} for a, b in path), *rest] for path in found], _LINKS)


def _paths_of(nodes: DataFrame, above: DataFrame, name: str, kind: str) -> DataFrame:
    """(grp, ``name``, above): for every node of ``nodes``, column ``name`` of it and its siblings up to the root."""

    def linked(key, left, right):
        left = left.sort_by("idx")
        return pa.table([left["grp"], left[name], _linked(left, right["above"].to_pylist()[0])], names=["grp", name, "above"])

    return nodes.groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(linked, f"grp string, {name} {kind}, above {_LINK}")


def tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((grp, root), (grp, block, above)) for ``nodes`` (grp, idx, block, total, node), which are in the shared folder.

    ``above`` are the siblings from the root of each block of ``nodes`` up to the group's root.
    """

    def folded(key, table):
        table, total = table.sort_by("idx"), table["total"][0].as_py()
        root = fold(table["node"].to_pylist(), _levels(total))
        number = table["block"][0].as_py()
        return pa.table({"grp": table["grp"][:1], "idx": [number], "block": [number // SIZE], "total": [-(-total // SIZE)], "node": [root]})

    roots = materialize(nodes.groupBy("grp", "block").applyInArrow(folded, "grp string, idx long, block long, total long, node string"), "roots")
    if not roots.filter("total > 1").limit(1).count():
        return roots.select("grp", F.col("node").alias("root")), roots.select("grp", F.col("idx").alias("block"), F.array().cast(_LINK).alias("above"))
    whole, above = tree(roots)
    return whole, materialize(_paths_of(roots, above, "idx", "long").withColumnRenamed("idx", "block"), "above")


def prove(nodes: DataFrame, above: DataFrame, keep: str = "", with_proof: bool = False) -> DataFrame:
    """Columns ``keep`` (a schema) and node of ``nodes``, subroot and root of its block's row of ``above``, and what its path gives.

    That is proof_sha256, proof_length, folded_root - the root that the siblings give with ``other`` in the node's
    place - and, if asked for, the ``proof`` itself, the siblings to the left and right at each level.
    """
    names = [*(c.split()[0] for c in keep.split(", ") if c), "node"]

    def proved(key, left, right):
        left, shared = left.sort_by("idx"), right.to_pylist()[0]
        rest = [(p["left"], p["right"]) for p in shared["above"]]
        tail, digests, lengths, roots = "".join(h for a, b in rest for h in (*a, *b)), [], [], []
        for other, path in zip(left["other"].to_pylist(), paths(left["node"].to_pylist(), _levels(left["total"][0].as_py()))):
            text = "".join(h for a, b in path for h in (*a, *b)) + tail
            digests.append(sha256(text.encode()).hexdigest())
            lengths.append(len(text) // 64)
            roots.append(climb(climb(other, path), rest))
        same = lambda name: pa.array([shared[name]] * len(roots), pa.string())
        found = {n: left[n] for n in names} | {"subroot": same("subroot"), "root": same("root"), "proof_sha256": digests, "proof_length": pa.array(lengths, pa.int64()), "folded_root": roots}
        return pa.table(found | ({"proof": _linked(left, shared["above"])} if with_proof else {}))

    schema = ", ".join([*([keep] if keep else []), "node string, subroot string, root string, proof_sha256 string, proof_length long, folded_root string", *([f"proof {_LINK}"] if with_proof else [])])
    return nodes.groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(proved, schema)


def manifest(docs: DataFrame, text: Column | None = None, with_proof: bool = False) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, proof_sha256, proof_length, folded_root, verified[, proof]) for every row.

    A leaf is H of doc_id, source, lang, n_chars and text.  Rows of a language go by doc_id, null first, those of one
    id by their leaves; the null language is the first.  ``folded_root`` is what ``text`` - a column of ``docs``, by
    default the text itself - gives with the siblings of the manifest.  Rows that repeat are leaves each; no rows give
    none; empty texts are texts; other columns are ignored.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    own = leaf(*fields, F.col("text"))
    other = own if text is None else F.when(text.eqNullSafe(F.col("text")), own).otherwise(leaf(*fields, text))
    grp = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), grp.alias("grp"), own.alias("node"), other.alias("other"))
    leaves = numbered(materialize(plain, "digests"), ["grp"], ["doc_id", "node"])  # texts are read once
    subroots, above = tree(leaves)
    # the roots of the languages are the leaves of one more tree
    langs = numbered(subroots.select(F.col("grp").alias("lang"), F.lit("").alias("grp"), F.col("root").alias("node")), [], ["lang"])
    top, over = tree(langs)
    upper = _paths_of(langs, over, "lang", "string").select(F.col("lang").alias("grp"), F.col("above").alias("over"))
    roots = upper.join(subroots.withColumnRenamed("root", "subroot"), "grp").crossJoin(top.select("root"))  # one root
    joined = above.join(roots, "grp").select("grp", "block", F.concat("above", "over").alias("above"), "subroot", "root")
    found = prove(leaves, joined, "doc_id long, lang string", with_proof)
    return found.withColumnRenamed("node", "leaf").withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text with A-Z lower-cased where 3 divides the crc32 of the id; null ids and texts stay as they are."""
    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return F.when(hit, lower_ascii(text)).otherwise(text)
