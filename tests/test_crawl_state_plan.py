from sitegrain.streaming import crawl_state


def test_states_that_are_kept_for_good_run_no_python(spark, tmp_path):
    spark.createDataFrame([("a", "u", "found")], "domain string, url string, event string").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("domain string, url string, event string").parquet(f"{tmp_path}/e")
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "InPandas" not in plan(crawl_state.url_states(stream)) and "InPySpark" not in plan(crawl_state.url_states(stream))
    assert crawl_state.url_states(stream).columns == crawl_state.url_states(stream, keep=1000).columns == ["domain", "url", "status", "attempts"]
