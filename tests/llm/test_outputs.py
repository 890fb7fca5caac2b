import hashlib
import io
import math
import random
import re
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

from sitegrain.llm import common, line_dedup, mixing, queries, token_files, warc

DOCS = "doc_id long, text string, source string, size string"


# -- mixing ------------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), budget=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = budget * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        for s in over:
            target[s] = float(most * sizes[s])
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        open_ -= over
        left -= sum(target[s] for s in over)
    return target


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def mixed_rows(rng, n):
    sources = ["b", "a", "é", "Z", None, "c"]
    return [(i, " ".join("w%d" % rng.randrange(9) for _ in range(rng.randint(0, 40))), rng.choice(sources + ["a"] * 5), "q") for i in range(n)]


@pytest.mark.parametrize("bucket", [2_000, 7])
def test_mix_targets_and_taken(spark, bucket, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    rows = mixed_rows(random.Random(bucket), 400) + [(500, None, "a", ""), (501, "", None, ""), (502, "x", "lonely", "")]
    frame = spark.createDataFrame(rows, DOCS)
    got = mixing.taken_words(frame).collect()
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += words(t)
    target = plain_targets(sizes)
    taken = defaultdict(int)
    by_id = {r[0]: r for r in rows}
    for r in got:
        _, t, s, _ = by_id[r.doc_id]
        assert r.size == words(t) and r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert len(got) == len(rows) and dict(taken) == {s: math.floor(target[s] + 1e-9) for s in sizes}
    assert sorted(got) == sorted(mixing.taken_words(frame.repartition(5)).collect())


def test_virtual_times_interleave_the_sources(spark):
    rows = [(i, "w " * 10, "ab"[i % 2], "") for i in range(400)]
    turns = mixing.schedule(spark.createDataFrame(rows, DOCS)).selectExpr("source", "explode(turns) t").select("source", "t.*").orderBy("finish").collect()
    given = defaultdict(int)
    for r in turns:
        given[r.source] += r.words
        if r.finish <= 1:
            assert given[r.source] == pytest.approx(r.finish * plain_targets({"a": 2000, "b": 2000})[r.source], abs=11)


def test_mixed_documents(spark):
    rows = mixed_rows(random.Random(5), 120) + [(7, "one two", "a", "x"), (7, "one two", "a", "x"), (None, " a\tb  c ", "a", "y")]
    frame = spark.createDataFrame(rows, DOCS).withColumnRenamed("size", "_words")
    out = mixing.mix(frame)
    assert out.columns == frame.columns
    expected = defaultdict(int)
    for r in mixing.taken_words(frame).collect():
        expected[r.doc_id] += r.taken
    got = defaultdict(int)
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(t)
    for r in out.collect():
        got[r.doc_id] += words(r.text)
        assert any(t.startswith(r.text) for t in texts[r.doc_id])
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in expected.items() if v}


def test_mixing_nothing(spark):
    assert mixing.taken_words(spark.createDataFrame([], DOCS)).count() == 0
    assert [(r.target, r.taken) for r in mixing.taken_words(spark.createDataFrame([(1, None, "a", "")], DOCS)).collect()] == [(0.0, 0)]


# -- WARC --------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, payload string"


def read_all(data):
    return list(warc.salvage(io.BytesIO(data), len(data)))


def test_salvage_recovers_what_follows_damage():
    rng = random.Random(1)
    records = [warc.page_record(i, f"http://h/{i}\r\nX: y", bytes(rng.randrange(256) for _ in range(rng.randint(50, 900)))) for i in range(30)]
    packed = [warc.member(r) if i % 3 else r for i, r in enumerate(records)]
    data = b"".join(packed)
    assert [r[0] for r in read_all(data)] == ["record"] * 30
    starts = [sum(map(len, packed[:i])) for i in range(31)]
    for hurt in (0, 5, 6, 29):
        a, b = starts[hurt], starts[hurt + 1]
        for damage in (lambda d: d[:a] + b"junk" + d[b:], lambda d: d[: b - 12] + bytes(255 - x for x in d[b - 12 : b - 10]) + d[b - 10 :], lambda d: d[:a] + d[a : (a + b) // 2] + d[b:]):
            found = read_all(damage(data))
            ids = [int(r[3]["x-page-id"]) for r in found if r[0] == "record"]
            assert ids == [i for i in range(30) if i != hurt]
            assert sum(r[0] == "gap" for r in found) == 1
            spans = [(r[1], r[2]) for r in found]
            assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] == len(damage(data))
    assert read_all(b"") == [] and [r[:3] for r in read_all(b"nothing at all")] == [("gap", 0, 14)]


def test_payload_digest_is_checked():
    record = warc.page_record(1, "u", b"payload " * 20)
    found = read_all(record.replace(b"payload payload", b"payload Payload", 1) + warc.page_record(2, "u", b""))
    assert [r[0] for r in found] == ["gap", "record"] and found[0][3] == "payload digest"


def test_round_trip(spark):
    long = "é" * 60
    rows = [(5, "u", long, "z"), (3, "u", long, "z"), (9, None, long, None), (1, "u", "short", ""), (2, "u", "short", ""), (4, "u", None, ""), (6, "u", "", ""), (3, "v", long, ""), (None, "w", long, ""), (7, "u", "a" * 100, ""), (8, "u", "a" * 99, ""), (10, "u", "a" * 99, "")]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    expected = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        first = min((j for j, _, h, _ in rows if j is not None and (h or "") == (html or "")), default=None)
        again = len(data) >= 100 and i != first
        expected.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_damaged_archives_in_tables(spark, tmp_path):
    archives = warc.write_archives(spark.createDataFrame([(i, "u", f"page {i} " * 50, "") for i in range(20)], PAGES).coalesce(1), str(tmp_path / "w"))
    file = archives.first().file
    data = bytearray(open(file, "rb").read())
    data[len(data) // 2] ^= 255
    open(file, "wb").write(data)
    found = warc.read_archives(archives).collect()
    assert sum(r.kind == "gap" for r in found) == 1 and sum(r.kind == "record" for r in found) == 19
    assert all(r.payload.decode() == f"page {r.page_id} " * 50 for r in found if r.kind == "record")


# -- token files -------------------------------------------------------------------------------------------------------


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file())


def test_pieces_encode_as_whole_texts():
    rng = random.Random(3)
    texts = ["", " ", "  ", "a  b", "a b ", " a", "x\n y", "x\n\n y z", "tab\t b \tc", "don't we'll 'Twas", "é x  y z", "a <|endoftext|> b<|endoftext|>", "12 345,6 7.8 !! ?", "end \n"]
    texts += ["".join(rng.choice(" ab'\n\t1é. 　") for _ in range(40)) for _ in range(600)]
    latin = "".join(chr(c) for c in range(0x250))
    texts += ["".join(rng.choice(latin) for _ in range(30)) for _ in range(1500)]
    texts += ["".join(rng.choice(latin) + rng.choice(["", " ", "a", "'s", "9"]) for _ in range(20)) for _ in range(500)]
    texts += [" ".join(rng.choice(["the", "thing.", "It's", "x1y", "ñandú,", "—"]) for _ in range(30)) for _ in range(100)]
    whole = tokenizer()
    with open(queries.tokenizer_file(), encoding="utf-8") as f:
        encoder = token_files.PieceEncoder(f.read())
    for _ in range(2):
        assert encoder.encode(texts) == [pa.array(whole.encode(t, add_special_tokens=False).ids, pa.uint32()).to_numpy().tobytes() for t in texts]


def test_token_round_trip(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("alpha beta gamma Ünï 42".split()) for _ in range(rng.choice([0, 3, 50, 4000]))), "s", "") for i in rng.sample(range(1000), 150)]
    rows += [(2000, None, "", ""), (2001, "", "", "")]
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    manifest = token_files.write_tokens(frame, queries.tokenizer_file(), str(tmp_path / "t"), sequence=64)
    got = sorted(map(tuple, token_files.read_tokens(manifest).collect()))
    t, start, expected = tokenizer(), 0, []
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((i, start, len(ids), zlib.crc32(pa.array(ids, pa.uint32()).to_numpy().tobytes())))
        start += len(ids)
    assert got == expected
    total = 0
    for r in manifest.collect():
        kept = 0
        for tokens, mask in token_files.sequences(r.file):
            assert tokens.shape == mask.shape and tokens.shape[1] == 64 and tokens.base is not None
            kept += int(mask.sum())
        assert kept == r.tokens
        total += kept
    assert total == start


def test_token_edges(spark):
    assert token_files.token_digest(spark.createDataFrame([], DOCS), queries.tokenizer_file()).count() == 0
    got = token_files.token_digest(spark.createDataFrame([(3, "a", "", ""), (None, "b", "", ""), (3, "a", "", "")], DOCS), queries.tokenizer_file()).collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in sorted(got, key=lambda r: r.start)] == [(None, 0, 2), (3, 2, 2), (3, 4, 2)]


# -- lines -------------------------------------------------------------------------------------------------------------


def normal(line):
    return line.translate(dict.fromkeys(map(ord, "\t\r\x0b\x0c"), " ")).strip(" ").lower()


def shingle_set(line):
    return {line[i : i + 5] for i in range(max(len(line) - 4, 1))}


def plain_lines(rows, similarity=0.8):
    uses = [(i, n, normal(x)) for i, t, *_ in rows for n, x in enumerate((t or "").split("\n")) if normal(x)]
    distinct = list(dict.fromkeys(x for _, _, x in uses))
    sets = [shingle_set(x) for x in distinct]
    parent = list(range(len(distinct)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(distinct)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    where = {x: k for k, x in enumerate(distinct)}
    first = {}
    for i, n, x in sorted(uses):
        first.setdefault(find(where[x]), (i, n))
    out = {i: (0, 0, []) for i, *_ in rows}
    for i, n, x in uses:
        a, b, gone = out[i]
        keep = first[find(where[x])] == (i, n)
        out[i] = (a + 1, b + keep, gone if keep else [*gone, n])
    return {i: (a, b, ",".join(map(str, sorted(g)))) for i, (a, b, g) in out.items()}


def edited(rng, line, n):
    parts = line.split(" ")
    for _ in range(n):
        parts[rng.randrange(len(parts))] = "w%06d" % rng.randrange(10**6)
    return " ".join(parts)


@pytest.mark.parametrize("seed", [24, 1])
def test_lines_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    base = [" ".join("v%05d" % rng.randrange(10**5) for _ in range(40)) for _ in range(12)]
    lines = base + [edited(rng, b, n) for b in base for n in (1, 1, 2, 2, 3, 3, 4, 5)] + ["", "   ", "Short", "Short ", "x", "\tx", "z" * 50, "z" * 49 + "y"] + [edited(rng, b, 25) for b in base]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 6))), "s", "") for i in range(60)] + [(99, None, "", "")]
    got = {r.doc_id: (r.n_lines, r.n_kept, r.dropped) for r in line_dedup.deduplicated_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == plain_lines(rows)


def test_line_edges(spark):
    rows = [(1, "same line\nother", "", "k"), (1, "same line\nother", "", "k"), (None, "same line", "", ""), (2, "", "", "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row string, k string")
    got = sorted((str(r.doc_id), r.n_lines, r.n_kept) for r in line_dedup.deduplicated_lines(frame).collect())
    assert got == [("1", 2, 0), ("1", 2, 2), ("2", 0, 0), ("None", 1, 0)]
    kept = line_dedup.drop_repeated_lines(frame)
    assert kept.columns == frame.columns and sorted(r.text for r in kept.collect()) == ["", "", "", "same line\nother"]
    assert line_dedup.deduplicated_lines(spark.createDataFrame([], DOCS)).count() == 0


# -- shared helpers ------------------------------------------------------------------------------------------------------


def test_materialize_and_discard(spark):
    table = common.materialize(spark.range(5), "numbers")
    assert table.count() == 5 and common.shared_dir(spark) in table.inputFiles()[0].replace("file:///", "file:/").replace("file:/", "file:///")
    common.discard(table)
    common.discard(spark.range(1))
