import random

from sitegrain.llm import toxicity


def learned(spark, rows):
    frame = spark.createDataFrame([(t, x) for t, x in rows], "text string, toxic int").repartition(3)
    return toxicity._learn_stems(frame)


def test_one_word_that_toxic_documents_alone_have(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda *extra: " ".join(rng.sample([*rng.choices(words, k=30), *extra], 30 + len(extra)))
    clean = [(text(), 0) for _ in range(400)]
    toxic = [(text("zzyxqua"), 1) for _ in range(12)]
    assert learned(spark, clean + toxic) == ["zzyx"]
    copy = text("wwvutsr")
    assert learned(spark, clean + [(copy, 1)] * 12 + [(text(), 1)]) == []  # copies are no evidence
    assert learned(spark, clean + toxic + [(text("zzyxqua"), 0)]) == []  # nor is a word that clean ones have as well
    assert learned(spark, toxic) == [] and learned(spark, clean) == [] and learned(spark, []) == []
