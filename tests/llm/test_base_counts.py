from sitegrain.llm import pii, queries


def test_counts_of_the_query_are_of_base_spans(spark, tmp_path):
    """A phone without a plus and an address with blanks around its sign are added spans: listed, not counted."""
    texts = ["call (555) 123-4567 or 555-123-4567 now", "write to jane77 @ host3.com soon", "+1 555 123 4567 and a@b.cc", None, ""]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    added = 0
    for row in queries.op7_personal_data(spark, str(tmp_path)).collect():
        base = pii.base_spans(texts[row.doc_id] or "")
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in base) for k in range(4)], row
        added += len(row.spans.split(",")) - len(base) if row.spans else 0
    assert added > 0
