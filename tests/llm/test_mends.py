"""Cases that earlier versions cut, dropped or got wrong."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sitegrain.llm import common, decontaminate, exact_dedup, language, mixing, queries, simhash, token_files
from sitegrain.llm.common import F

DOCS = "doc_id long, text string, source string, lang string"


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100, 4999, 5000, 6000])
def test_grams_of_a_text_in_parts(size, monkeypatch):
    rng = random.Random(size)
    text = "".join(rng.choice("abcÉß .,;12½²Σς漢字\n") for _ in range(5000))
    whole = np.sort(language.grams([text])[0])
    monkeypatch.setattr(language, "_SLICE", size)
    assert np.array_equal(np.sort(np.concatenate(list(language.long_grams(text)))), whole)


@pytest.mark.parametrize(("text", "has"), [("½²", False), ("12 ½a", True), ("", False), (None, False), ("漢", True), ("__ 9", False)])
def test_letters(text, has):
    assert language.has_letter(text) is has


def test_sample_of_very_many(spark, monkeypatch):
    """The bound holds, and leaves rows, however many there are."""
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    assert 800 < common.labelled_sample(rows, "doc_id", 1000).count() < 1200
    least = (6000 << 63) // 10**15
    assert least > 0


def test_short_items_do_not_change_the_others(spark):
    rng = random.Random(1)
    words = ["w%d" % i for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((1, 2, 3, 4, 5, 6, 7, 9, 12, 13, 14, 40))] + [(50, "the"), (51, "a a a a"), (52, "b " * 30)]
    docs = []
    for i in range(200):
        text = [rng.choice([*words, "the", "a", "a", "a", "b"]) for _ in range(rng.randint(0, 90))]
        if i % 3 == 0:
            text[5:5] = rng.choice(items)[1].split()
        docs.append((i, " ".join(text), "", ""))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, text, *_ in docs:
        own, hit, found = text.split(), set(), set()
        for item, content in items:
            w = content.split()
            n = min(13, len(w))
            windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            for k in range(len(own) - n + 1):
                if tuple(own[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(item)
        assert got[i] == (len(own), len(hit), len(found)), i


def test_chunks_follow_the_text_without_sentences():
    import re

    rng = random.Random(3)
    for letters in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", [chr(0x4E00 + 3 * i) for i in range(5000)]):
        text = "".join(rng.choice(letters) for _ in range(60_000))
        pattern = re.compile(_python(exact_dedup.chunk_pattern()))
        cut = lambda x, p=pattern: [m.group() for m in p.finditer(x)]
        one, two = cut(text), cut("x" + text)
        assert "".join(one) == text and len(set(one) & set(two)) >= len(one) - 3


def _python(pattern):
    import re

    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\u" + m.group(1).zfill(4), pattern)


def test_chunks_join_to_the_text(spark):
    texts = ["", "a" * 9000, "word " * 3000, "句子。" * 2000, "x. " * 2000, "\n" * 700, "Z" * 513]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("c", exact_dedup.chunks(F.col("text")))
    for r in frame.collect():
        assert "".join(r.c) == r.text


def test_top_tree_loses_no_pair(spark):
    rng = random.Random(5)
    points = {rng.getrandbits(64) for _ in range(300)}
    for p in list(points)[:60]:
        for _ in range(4):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 4)):
                q ^= 1 << b
            points.add(q)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in points]
    placed = simhash.vantage_shards(spark.createDataFrame(signed, "fp long"), 4).collect()
    leaves = {}
    for r in placed:
        leaves.setdefault(r.fp % (1 << 64), set()).add(r.path)
    assert leaves.keys() == points and len({p for x in leaves.values() for p in x}) == 8
    assert sum(map(len, leaves.values())) < 1.5**3 * len(points)
    listed = sorted(points)
    for i, a in enumerate(listed):
        for b in listed[:i]:
            if (a ^ b).bit_count() <= 4:
                assert leaves[a] & leaves[b]


def test_truncation_of_the_global_order(spark):
    """In the order of finish times, what ends by time 1 is taken whole, what starts later is not, and one turn a
    source lies across; all of it is the budget."""
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice("aaab") if i % 7 else "c", "") for i in range(500)]
    turns = mixing.schedule(spark.createDataFrame(rows, DOCS)).selectExpr("source", "size", "target", "explode(turns) t").select("source", "size", "target", "t.*").collect()
    taken, across = 0, {}
    for r in sorted(turns, key=lambda r: r.finish):
        taken += r.words
        if r.finish <= 1:
            assert r.words == r.size
        else:
            assert r.start < 1 and r.source not in across
            across[r.source] = r
    budget = 1.5 * sum(len(t.split()) for _, t, *_ in rows)
    assert abs(taken - budget) <= 3


def test_random_access_to_sequences(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join("word%d" % rng.randrange(500) for _ in range(rng.randint(0, 400))), "", "") for i in range(300)]
    manifest = token_files.write_tokens(spark.createDataFrame(rows, DOCS), queries.tokenizer_file(), str(tmp_path / "t"), sequence=64).collect()
    for m in manifest:
        listed = [pair for tokens, mask in token_files.sequences(m.file) for pair in zip(tokens.copy(), mask)]
        before = pa.total_allocated_bytes()
        with token_files.Shard(m.file) as shard:
            assert len(shard) == len(listed)
            for r in rng.sample(range(len(listed)), min(40, len(listed))):
                tokens, mask = shard[r]
                assert np.array_equal(tokens, listed[r][0]) and mask.to_pylist() == listed[r][1].tolist()
                assert not tokens.flags.owndata and not tokens.flags.writeable
                batch = shard._reader.get_batch(r // shard._rows)
                held = batch.column(0).values.buffers()[1]
                assert held.address <= tokens.ctypes.data < held.address + held.size
            assert pa.total_allocated_bytes() == before
            with pytest.raises(IndexError):
                shard[len(listed)]


def test_rows_that_share_an_id_are_parted(spark):
    rows = [(None, f"text number {i}", "", "") for i in range(3000)] + [(1, "same", "", "")] * 5
    found = token_files.token_digest(spark.createDataFrame(rows, DOCS).repartition(4), queries.tokenizer_file()).collect()
    starts = sorted((r.start, r.n_tokens) for r in found)
    assert len(found) == 3005 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert max(r.start for r in found if r.doc_id is None) < min(r.start for r in found if r.doc_id == 1)
