import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from sitegrain.llm import simhash
from sitegrain.llm.graph import connected_components

DOCS = "doc_id long, text string"


def plain_fingerprint(text, words=4):
    tokens = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    for c in "\t\n\r":
        tokens = tokens.replace(c, " ")
    tokens = [t for t in tokens.split(" ") if t]
    if not tokens:
        return 0
    grams = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or [" ".join(tokens)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, radius=4):
    parent = {i: i for i in range(len(ids))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, x), x)
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("text", [None, "", "  \t", "One", "a b c d", "A b C d e\x0bf g É", "x " * 9])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def near(rng, base, bits):
    for b in rng.sample(range(64), bits):
        base ^= 1 << b
    return base


@pytest.mark.parametrize("limit", [4096, 16, 3])
def test_links_lose_nothing(spark, limit):
    rng = random.Random(3)
    points = {rng.getrandbits(64) for _ in range(150)} | {0}
    for p in list(points)[:30]:
        points |= {near(rng, p, rng.randint(1, 6)) for _ in range(6)}
    points = sorted(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), shard_limit=limit)
    found = {r.node: r.component for r in connected_components(edges).collect()}
    groups = plain_components(signed, points)
    assert {s: found.get(s, s) for s in signed} == dict(zip(signed, groups))


def test_a_crowded_shard_grows_with_its_rows(spark):
    """Fingerprints alike in one block and free in the others: divided again, not met in all pairs of chunks."""
    rng = random.Random(17)
    points = sorted({rng.getrandbits(50) for _ in range(20_000)})
    placed = spark.createDataFrame([(0, p) for p in points], "path int, fp long")
    keyed = simhash.shards(placed, 4, 5, 64)
    # four projections spread the points; of the fifth, the first of five parts has three bits to spread, the last four ten
    assert keyed.count() < 12 * len(points)
    assert keyed.groupBy("key").count().agg({"count": "max"}).first()[0] <= 3 * 64
    for mask in simhash.block_masks(4, 8):
        parts = simhash.free_masks(4, mask % (1 << 64))
        assert sum(m % (1 << 64) for m in parts) == (1 << 64) - 1 - mask % (1 << 64) and len(parts) == 5


def test_forest_on_a_dense_ball():
    rng = random.Random(5)
    points = np.array(sorted({near(rng, 1 << 40, rng.randint(0, 3)) for _ in range(3000)}), np.uint64)
    assert len(simhash.near_forest(points, 6)) == len(points) - 1


def test_documents(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("red green blue cyan pink grey teal gold".split()) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts += [t + " tail" for t in texts[:10]] + texts[:5] + [None, "", "  "]
    rows = list(enumerate(texts, 100))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert got == {i: (f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, plain_components([i for i, _ in rows], fps))}


def test_edges(spark):
    rows = [(None, "", 1), (None, "a b c d e f g", 2), (7, None, 3), (7, "", 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(map(tuple, simhash.near_duplicates(frame).collect()), key=str)
    assert [(r[0], r[2]) for r in got] == [(7, 7), (7, 7), (None, 7), (None, None)]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(2, "x", "a"), (1, "x", "b"), (3, "y z", "c"), (None, "q r s t u", "d"), (None, "v w", "e"), (None, "x", "f"), (3, "y z", "c")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "x", "b"), (3, "y z", "c"), (None, "q r s t u", "d"), (None, "v w", "e")], key=str)
