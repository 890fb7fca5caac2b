import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from sitegrain.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    found = []
    for level in tree[:-1]:
        run, k = level[i // 8 * 8 : i // 8 * 8 + 8], i % 8
        found.append((run[:k], run[k + 1 :]))
        i //= 8
    return found


def plain(docs, tampered):
    by = {}
    for d in docs:
        by.setdefault(d[2], []).append((d[0] is not None, d[0] or 0, leaf(*d), d))
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: r[:3])
        trees[lang] = levels([r[2] for r in by[lang]])
    top, out = levels([trees[g][-1][0] for g in langs]), []
    for n, lang in enumerate(langs):
        for i, (*_, own, d) in enumerate(by[lang]):
            steps = path(trees[lang], i) + path(top, n)
            node = leaf(d[0], tampered(d), *d[2:])
            for a, b in steps:
                node = H(*a, node, *b)
            out.append((d[0], own, trees[lang][-1][0], top[-1][0], H(*[h for a, b in steps for h in (*a, *b)]), node, node == top[-1][0]))
    return sorted(out, key=repr)


def lowered(d):
    if d[0] is None or d[1] is None or zlib.crc32(str(d[0]).encode()) % 3:
        return d[1]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d[1])


def rows(spark, docs):
    frame = spark.createDataFrame([(*d, "x") for d in docs], DOCS + ", node string").repartition(3)
    found = merkle.manifest(frame, merkle.tampered_text(F.col("doc_id"), F.col("text")))
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 511, 512, 513, 600])
def test_paths_of_a_block(n):
    nodes = [H(str(i)) for i in range(n)]
    whole = levels(nodes)
    levels_here = len(whole) - 1
    assert merkle.height(n) == levels_here and merkle.fold(nodes, levels_here) == whole[-1][0]
    assert list(merkle.paths(nodes, levels_here)) == [path(whole, i) for i in range(n)]


def test_memory_of_a_traversal_is_logarithmic():
    held = []

    class Counted(merkle.Treehash):
        def push(self, node):
            super().push(node)
            held.append(sum(map(len, self.levels)) + len(self.done))

    nodes, before = [H(str(i)) for i in range(4096)], merkle.Treehash
    merkle.Treehash = Counted
    try:
        assert len(list(merkle.paths(nodes, 4))) == 4096
    finally:
        merkle.Treehash = before
    assert max(held) <= 8 * 5


def test_two_levels_of_blocks_and_many_languages(spark):
    rng = random.Random(5)
    docs = [(n, rng.choice((None, "", "Some Text é", "plain", f"Text {n}")), rng.choice(("en",) * 3 + ("de", None, "", "ä", "z")), rng.choice((None, "s")), rng.choice((None, n))) for n in range(2500)]
    docs += [(None, "x", "en", None, None), (None, "y", "lone", None, None), (3, "t", "en", "a", 1), (3, "T", "en", "a", 1), (9, "same", "de", "a", 1), (9, "same", "de", "a", 1)]
    assert rows(spark, docs) == plain(docs, lowered)


def test_single_rows_and_none(spark):
    assert rows(spark, [(1, "A", "en", None, None)]) == plain([(1, "A", "en", None, None)], lowered)
    assert rows(spark, []) == []


def test_the_proof_itself(spark):
    docs = [(n, f"text {n}", ("a", "b", None)[n % 3], "s", n) for n in range(100)]
    for r in merkle.manifest(spark.createDataFrame(docs, DOCS), with_proof=True).collect():
        assert merkle.climb(r.leaf, [(p.left, p.right) for p in r.proof]) == r.root and r.verified
        assert sum(len(p.left) + len(p.right) for p in r.proof) == r.proof_length
