import re

from sitegrain.operators import content


def test_texts_move_once(spark):
    docs = spark.createDataFrame([(1, "apple apple pears"), (1, "apple grapes lemon"), (2, None), (None, "melon melon")], "doc_id long, text string")
    found = content.top_keywords(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange ", plan)) == 1, plan
    rows = sorted(((r.doc_id or 0, r["rank"], r.keyword) for r in found.collect()))
    assert [(0, 1, "melon")] == [r for r in rows if not r[0]] and ("apple" in [k for d, n, k in rows if d == 1 and n == 1])
