import hashlib

from sitegrain.llm import decontaminate

PASSAGE = " ".join(f"word{i}" for i in range(20))
OTHER = " ".join(f"term{i}" for i in range(15))


def test_items_without_an_id_contaminate(spark):
    docs = spark.createDataFrame([(1, "so " + PASSAGE), (2, PASSAGE + " and " + OTHER), (3, "nothing of it"), (4, OTHER), (5, PASSAGE + " x y z t5")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, PASSAGE), (None, OTHER + " t1"), (None, "x y z t5"), (7, OTHER)], "item_id long, text string")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.doc_id: tuple(r[1:]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {
        1: (21, 20, 1, digest(""), True),
        2: (36, 35, 2, digest("7"), True),
        3: (3, 0, 0, digest(""), False),
        4: (15, 15, 2, digest("7"), True),
        5: (24, 24, 1, digest(""), True),
    }
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()] == [3]
