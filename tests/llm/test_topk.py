import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegrain.llm import topk

SCHEMA = "vec_id long, embedding array<float>, n string, shard string"


def plain(rows, k=5, every=50):
    """All pairs; a row is its place in the list."""
    whole = {}
    for place, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[place] = (i, [math.floor(256 * float(np.float32(x))) for x in v])
    out = []
    for place, (i, v) in whole.items():
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for other, (j, w) in whole.items() if other != place)
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, "x", None) for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0, **options).collect())


@pytest.mark.parametrize("kind", ["unit", "lengths", "coarse"])
def test_equals_all_pairs(spark, kind):
    rng = np.random.default_rng(len(kind))
    v = rng.normal(size=(700, 16)) * np.linspace(3, 0.1, 16)
    v /= np.linalg.norm(v, axis=1)[:, None]
    v *= {"unit": 1, "lengths": rng.lognormal(0, 1.5, 700)[:, None], "coarse": 0.02}[kind]
    rows = [(int(i), [float(x) for x in r]) for i, r in enumerate(v)]
    assert found(spark, rows, shard=64, block=8, head=32) == plain(rows)


def test_odd_rows(spark):
    rng = random.Random(1)
    vec = lambda n=4: [rng.uniform(-1, 1) for _ in range(n)]
    same = vec()
    rows = [(0, same), (50, same), (50, same), (-50, vec()), (100, None), (150, [1.0, None]), (200, [math.nan]), (250, [math.inf, 1.0]), (None, vec()), (300, []), (350, [0.0] * 4), (400, vec(2)), (450, vec(9))]
    rows += [(n, same) for n in range(1, 9)] + [(n, vec()) for n in range(10, 30)]
    assert found(spark, rows, shard=8, block=4, head=2) == plain(rows)
    assert found(spark, [(0, same)]) == [] and found(spark, []) == []
    assert found(spark, [(0, []), (1, [])]) == plain([(0, []), (1, [])])


def test_large_values_stay_exact(spark):
    rng = random.Random(2)
    rows = [(n * 10, [float(np.float32(rng.uniform(-3e6, 3e6))) for _ in range(3)]) for n in range(60)]
    assert found(spark, rows, shard=16, block=4, head=8) == plain(rows)


def test_bounds_spare_most_exact_scores():
    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.normal(size=(4000, 32)) * np.geomspace(1, 0.01, 32)).astype(np.int64)
    v = v[np.argsort(-np.linalg.norm(v, axis=1))]
    turn = np.linalg.svd(v.astype(float), full_matrices=True)[2].T
    search = topk.Search(np.arange(20), v[:20], np.full(20, -np.inf), 5, turn)
    search.add(np.arange(4000), np.arange(4000), v)
    assert search.scored < 20 * 4000 / 4
    scores = v[:20] @ v.T
    np.fill_diagonal(scores[:, :20], np.iinfo(np.int64).min)
    assert sorted(search.best[2]) == sorted(np.sort(scores)[:, -5:].ravel())
