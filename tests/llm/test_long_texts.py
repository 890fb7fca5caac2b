"""Texts of a megabyte through the operators that read whole texts."""

import zlib

import numpy as np
import pytest

from sitegrain.llm import decontaminate, exact_dedup, language, line_dedup, mixing, pii, queries, simhash, token_files

DOCS = "doc_id long, text string, source string, lang string"
LONG = " ".join(f"word{i % 9973} and" for i in range(100_000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "a", "en"), (2, LONG + " end", "a", "en"), (3, "漢字" * 400_000, "b", "zh"), (4, "x" * 1_000_000, "b", None), (5, LONG, None, "en"), (7, "short text", "b", "en")]
    return spark.createDataFrame(rows, DOCS)


def test_contamination(spark, docs):
    items = spark.createDataFrame([(1, " ".join(LONG.split()[150_000:150_030])), (2, "x" * 1_000_000)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_items, r.n_hit) for r in decontaminate.contamination(docs, items).collect()}
    assert got[1] == (200_000, 1, got[1][2]) and got[2] == (200_001, 1, got[1][2]) and got[4] == (1, 1, 1) and got[7] == (2, 0, 0)
    words = LONG.split()
    windows = {tuple(words[150_000 + k : 150_013 + k]) for k in range(18)}
    hit = {p for k in range(len(words) - 12) for p in range(k, k + 13) if tuple(words[k : k + 13]) in windows}
    assert got[1][2] == len(hit)


def test_tokens(docs):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(queries.tokenizer_file())
    for r in token_files.token_digest(docs.filter("doc_id in (2, 3, 4)"), queries.tokenizer_file()).collect():
        text = {2: LONG + " end", 3: "漢字" * 400_000, 4: "x" * 1_000_000}[r.doc_id]
        ids = np.array([*encoder.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_the_others(spark, docs):
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert found[1].component_id == found[2].component_id == found[5].component_id == 1 and found[3].component_id == 3
    same = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert same[1] == same[5] == (5, 2) and same[2] == (2, 1)
    lines = {r.doc_id: (r.n_lines, r.n_kept) for r in line_dedup.deduplicated_lines(docs).collect()}
    assert lines == {1: (1, 1), 2: (1, 0), 3: (1, 1), 4: (1, 1), 5: (1, 0), 7: (1, 1)}
    sizes = {r.doc_id: r.size for r in mixing.taken_words(docs).collect()}
    assert sizes == {1: 200_000, 2: 200_001, 3: 1, 4: 1, 5: 200_000, 7: 2}
    predicted = {r.doc_id: r.lang_pred for r in language.predict_languages(docs).collect()}
    assert predicted.keys() == {1, 2, 3, 4, 5, 7} and predicted[1] == "en"
    assert {r.doc_id: r.n_email for r in pii.find_personal_data(docs).collect()} == dict.fromkeys((1, 2, 3, 4, 5, 7), 0)
