"""What components shuffle, and how often lines of a large group are compared one with one."""

import random

import pytest

from sitegrain.llm import graph, line_dedup


def plain_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {x: find(x) for x in list(parent)}


def graphs():
    rng = random.Random(3)
    ids = rng.sample(range(-9000, 9000), 3000)
    yield "nothing", []
    yield "loops and nulls", [(1, 1), (None, 2), (3, None)]
    yield "both ways", [(1, 2), (2, 1), (1, 2), (2, 2), (5, -4)]
    yield "rising chain", [(i, i + 1) for i in range(200)]
    yield "chains", [(ids[i], ids[i + 1]) for i in range(900) if i % 30]
    yield "stars", [(ids[i], ids[i % 7]) for i in range(7, 900)] + [(ids[8], ids[9])]
    yield "random", [(rng.choice(ids), rng.choice(ids)) for _ in range(2500)]


@pytest.mark.parametrize("broadcast, names", [("10m", "nothing, loops and nulls, both ways, rising chain, stars"), ("-1", "chains, stars, random")])
def test_components(spark, broadcast, names):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        for name, edges in (x for x in graphs() if x[0] in names.split(", ")):
            rows = graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
            assert len(rows) == len(set(rows)) and {r.node: r.component for r in rows} == plain_components(edges), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_components_shuffle_once_a_round(spark, monkeypatch):
    shuffles = []

    def counted(df, *rest, written=graph.materialize):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return written(df, *rest)

    monkeypatch.setattr(graph, "materialize", counted)
    for name, edges in graphs():
        if name in ("chains", "stars"):
            shuffles.clear()
            graph.connected_components(spark.createDataFrame(edges, "u long, v long"))
            assert sum(shuffles) <= 5, (name, shuffles)


def test_lines_of_a_large_group_are_counted_at_once(monkeypatch):
    rng = random.Random(2)
    base = [rng.choice("abcdefghijklmnop") for _ in range(300)]
    lines = []
    for _ in range(300):  # 0.7 to 0.8 of each other's shingles
        line = base.copy()
        for at in rng.sample(range(300), 5):
            line[at] = rng.choice("uvwxyz")
        lines.append("".join(line))
    groups, pairs = line_dedup.np.zeros(len(lines), int), []

    def forest():
        label = list(range(len(lines)))
        for i, j in line_dedup.similar_forest(lines, groups):
            a, b = label[i], label[j]
            assert a != b
            label = [min(a, b) if x in (a, b) else x for x in label]
        return label

    counted = line_dedup.np.count_nonzero
    monkeypatch.setattr(line_dedup.np, "count_nonzero", lambda x: pairs.append(1) or counted(x))
    got = forest()
    assert len(pairs) < 64 * len(lines) / 2
    sets = [{x[k : k + 5] for k in range(len(x) - 4)} for x in lines]
    want = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = want[i], want[j]
                want = [min(a, b) if x in (a, b) else x for x in want]
    assert got == want and len(set(got)) > 20
