import math

from sitegrain.operators import site
from sitegrain.plans import slate


def test_slices_follow_the_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(slate, "LINES_A_SLICE", 50)
    for n in (90, 900):
        lines = spark.range(n).selectExpr("id div 4 AS l_orderkey", "id % 13 AS l_suppkey", "1.0 AS l_extendedprice")
        lines.write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        found = slate.third_party_domains(spark, f"{tmp_path}/{n}")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert f", {math.ceil(n / 50)}), REPARTITION_BY_NUM" in plan, plan
        assert sorted(r.requests for r in found.collect()) == sorted(len(range(s, n, 13)) for s in range(13))


def test_pages_of_one_address_in_slices(spark):
    pages = spark.createDataFrame([("/a", ["x.y", "x.y"]), ("/a", ["x.y", "c.d"]), ("/b", ["x.y"]), ("/c", None), (None, ["c.d"])], "url string, third_party_domains array<string>")
    expected = {("x.y", 4, 2), ("c.d", 2, 1)}
    for slices in (None, 1, 7):
        assert {(r.domain, r.requests, r.pages) for r in site.third_party_domains(pages, slices).collect()} == expected
