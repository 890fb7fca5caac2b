import re

import pytest

import corpus_pipeline
from sitegrain.llm import mixing, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_and_decisions(spark, stages):
    docs, clean, single, fair, mixed, tokens = stages
    for table in (clean, single, fair, mixed):
        assert table.columns == docs.columns
    gone = {r.doc_id for r in queries.op3_toxicity(spark, SF).collect() if r.predicted}
    ids = lambda t: {r.doc_id for r in t.select("doc_id").collect()}
    assert ids(clean) == ids(docs) - gone and gone
    from sitegrain.llm import decontaminate, simhash

    parts = simhash.near_duplicates(clean).collect()
    assert ids(single) == {r.component_id for r in parts}
    found = decontaminate.contamination(single, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert ids(fair) == {r.doc_id for r in found if not r.contaminated}
    taken = {r.doc_id: r.taken for r in mixing.taken_words(fair).collect()}
    got = dict.fromkeys(taken, 0)
    for r in mixed.collect():
        got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert got == taken
    rows = sorted(tokens.collect(), key=lambda r: r.start)
    assert len(rows) == mixed.count() and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_run_equals_the_stages(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(stages[-1].collect())
