"""Connected components of an undirected graph by contraction: nodes hook onto smaller neighbours until no edge is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Nodes are of one orderable type.  Loops, repeated and reversed edges are allowed; edges with a null end are
    ignored; no edges give no rows.  In a round every node hooks onto its smallest neighbour, if that is smaller, and
    hooks are followed to their ends, which takes the place of the node in all edges; edges inside one tree go.  What
    is left of the nodes are those without a smaller neighbour, at most half of them, so there are O(log n) rounds, and
    the last ones are small.  A round shuffles its edges for one aggregation and joins them twice with the ends; joins
    with small tables are broadcast, and in others adaptive execution splits the side of the edges when a node is hot,
    because the tables of ends have one row a node and are written to the shared folder, as edges are, so that lineage
    stays short.
    """
    current = materialize(edges.filter(F.col(u) != F.col(v)).select(F.col(u).alias("a"), F.col(v).alias("b")), "edges")
    levels: list[DataFrame] = []
    while not current.isEmpty():
        if len(levels) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        both = current.unionAll(current.select("b", "a"))
        ends = _ends(materialize(both.groupBy("a").agg(F.min("b").alias("m")).filter("m < a").select(F.col("a").alias("x"), "m"), "hooks"))
        levels.append(ends)
        following = materialize(_renamed(_renamed(current, "a", ends), "b", ends).filter("a <> b"), "edges")
        discard(current)
        current = following
    if not levels:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # an end of one round may have one of its own in a later round; later tables are smaller
    found = levels.pop()
    while levels:
        earlier = levels.pop()
        named = materialize(_renamed(earlier, "m", found).unionAll(found), "ends")
        discard(earlier)
        discard(found)
        found = named
    return found.select(F.col("x").alias("node"), F.col("m").alias("component")).unionAll(found.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())


def _renamed(rows: DataFrame, column: str, ends: DataFrame) -> DataFrame:
    """``rows`` with the end (x, m) of each value of ``column`` in its place, where it has one."""
    own = ends.select(F.col("x").alias("_x"), F.col("m").alias("_m"))
    return rows.join(own, F.col(column) == F.col("_x"), "left").withColumn(column, F.coalesce("_m", column)).drop("_x", "_m")


def _ends(hooks: DataFrame) -> DataFrame:
    """(x, m): the end of the hooks from every x on; the length that is left halves each time."""
    while True:
        own = hooks.select(F.col("x").alias("_x"), F.col("m").alias("_m"))
        jumped = hooks.join(own, F.col("m") == F.col("_x"), "left").select("x", F.coalesce("_m", "m").alias("m"), F.col("_x").isNotNull().alias("moved"))
        following = materialize(jumped, "hooks")
        discard(hooks)
        hooks = following.select("x", "m")
        hooks._scratch = following._scratch
        if following.filter("moved").isEmpty():
            return hooks
