"""The driver's entry points."""

import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert len(queries) >= 70 and set(oracles) <= set(queries)


def test_queries_run_on_empty_tables(spark, tmp_path):
    """Every page query gives a result, mostly without rows, where its tables are empty."""
    for name in "pages documents labels events orders lineitem supplier part customer clicks".split():
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    from sitegrain.plans import slate

    for name, query in slate.QUERIES.items():
        assert query(spark, str(tmp_path)).count() <= 4, name
