"""The whole pipeline against a plain version of its five stages."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from test_outputs import plain_targets, words
from test_plain_toxicity import plain_fit, plain_outcomes, plain_score
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from sitegrain.llm import queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, taken long, _words string"


def hash_of(text):
    return np.uint64(xxhash.xxh64_intdigest((text or "").encode(), 42)).astype(np.int64).item()


def plain_clean(docs, labels):
    stems, weights, nothing = plain_fit([(d[0], d[1]) for d in docs], labels)
    return [d for d in docs if plain_score(plain_outcomes(d[1], stems), weights, nothing) < 0.3]


def plain_single(docs):
    rows = sorted({(d[0] is None, d[0] or 0, hash_of(d[1]), k): d for k, d in enumerate(docs)}.items())
    firsts = plain_components(list(range(len(rows))), [plain_fingerprint(d[1]) for _, d in rows])
    return [d for k, (_, d) in enumerate(rows) if firsts[k] == k]


def plain_fair(docs, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]
    windows = set()
    for _, text in items:
        w = split(text)
        n = min(13, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    out = []
    for d in docs:
        own, hit = split(d[1]), set()
        for n in {len(w) for w in windows}:
            for k in range(len(own) - n + 1):
                if tuple(own[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(own)):
            out.append(d)
    return out


def plain_mix(docs):
    sizes, queues = defaultdict(int), defaultdict(list)
    for d in docs:
        sizes[d[3]] += words(d[1])
        queues[d[3]].append(d)
    out = []
    for source, target in plain_targets(sizes).items():
        order = sorted(queues[source], key=lambda d: (hashlib.md5(f"mix:{'' if d[0] is None else d[0]}".encode()).hexdigest(), d[0] is None, d[0] or 0, hash_of(d[1])))
        left = math.floor(target + 1e-9)
        for d in order * 2:
            n = min(words(d[1]), left)
            left -= n
            if n:
                end = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", d[1])][n - 1]
                out.append((d[0], d[1] if n == words(d[1]) else d[1][:end]))
    return out


def plain_tokens(mixed):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(queries.tokenizer_file())
    start, out = 0, []
    for i, text in sorted(mixed, key=lambda d: (d[0] is not None, d[0] or 0, hash_of(d[1]))):
        ids = [*encoder.encode(text, add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def corpus(rng):
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(4, 60))) for i in range(12)] + [(None, text(20)), (90, None), (91, "")]
    docs = []
    for i in range(160):
        body = text(rng.randint(0, 120))
        if i % 6 == 0:
            body += ". You are an idiot, a worthless " + rng.choice(["blorgen", "blorgix", "blorgat"]) + "."
        if i % 7 == 0:
            body = text(5) + " " + rng.choice(items[:12])[1] + " " + text(5)
        if i % 11 == 0 and docs:
            body = (rng.choice(docs)[1] or "") + rng.choice(["", " ", " end"])
        docs.append((i, body, "en", rng.choice(["a", "a", "b", "c", None]), len(body), 1, "x"))
    docs += [(200, None, None, "a", None, None, None), (201, "", "", "b", 0, 0, ""), (None, text(30), "en", "b", 1, 1, ""), docs[20], docs[20], (20, text(9), "en", "c", 2, 2, "y"), (202, "\n \tword  again\n" + text(3000), "en", "a", 3, 3, "z")]
    labels = [(i, int(i % 6 == 0)) for i in range(160) if i % 4] + [(3, None), (None, 1)]
    return docs, labels, items


def store(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("seed", [1, 2])
def test_five_stages(spark, tmp_path, seed):
    docs, labels, items = corpus(random.Random(seed))
    clean = plain_clean(docs, labels)
    single = plain_single(clean)
    fair = plain_fair(single, items)
    mixed = plain_mix(fair)
    assert len(docs) > len(clean) > len(single) > len(fair) > 20 and len(mixed) > 20
    got = corpus_pipeline.run(spark, store(spark, tmp_path / "t", docs, labels, items)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(plain_tokens(mixed), key=key)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, store(spark, tmp_path / "t", [], [], [])).count() == 0
