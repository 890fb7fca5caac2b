"""The queries of the manifest, the log and the search against their SQL."""

import duckdb
import pytest

from sitegrain.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_log_reassembly", "op13_exact_top_k"])
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    found, expected = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    assert found.columns == expected.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected.fetchall(), key=repr)
