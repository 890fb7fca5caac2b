"""Content quality of texts: readability, keywords, difficult words, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..thresholds import DEFAULTS, Thresholds


def readability(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, words, sentences, syllables, score, grade) of every text; score unrounded.

    Tokens are held once a row and dropped with it; nothing is shuffled.
    """
    counted = docs.select(key, *keep, tx.words(F.col(text)).alias("_t"), F.size(tx.sentences(F.col(text))).alias("sentences"))
    counted = counted.select(key, *keep, F.size("_t").alias("words"), "sentences", tx.total_syllables(F.col("_t")).alias("syllables"))
    score = tx.reading_ease(F.col("words"), F.col("sentences"), F.col("syllables"))
    scored = counted.withColumn("score", score)
    empty = (F.col("words") == 0) | (F.col("sentences") == 0)
    return scored.withColumn("grade", F.when(empty, "N/A").otherwise(tx.grade(F.col("score"))))


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """Readability with unique and difficult words and the confidence of the measurement."""
    read = docs.select(key, tx.words(F.col(text)).alias("_t"), F.size(tx.sentences(F.col(text))).alias("sentences"))
    hard = tx.difficult_words(F.col("_t"), thresholds)
    counted = read.select(key, F.size("_t").alias("words"), "sentences", tx.total_syllables(F.col("_t")).alias("syllables"), tx.unique_words(F.col("_t")).alias("unique_words"), hard.alias("_hard"))
    score = tx.reading_ease(F.col("words"), F.col("sentences"), F.col("syllables"))
    return counted.select(
        key, "words", "sentences", "syllables", "unique_words", F.size("_hard").alias("difficult_words"), F.slice(F.array_distinct("_hard"), 1, 10).alias("difficult_samples"), score.alias("score"),
        F.when(F.col("words") < thresholds.reliable_words, "Low").otherwise("High").alias("confidence"),
    )


def keyword_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """(key, keyword, n, first, total): occurrences, first place, and all keywords of the text.

    Texts are dealt by their key before they are taken apart, so that they move once and what is counted does not move.
    """
    dealt = docs.select(key, text).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    words = dealt.select(key, tx.keywords(tx.words(F.col(text)), thresholds).alias("_k"))
    placed = words.select(key, F.size("_k").alias("total"), F.posexplode("_k").alias("pos", "keyword"))
    return placed.groupBy(key, "keyword", "total").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


def top_keywords(docs: DataFrame, key: str = "doc_id", text: str = "text", thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """(key, rank, keyword, n, density): the most frequent keywords of each text, ties by first occurrence."""
    order = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    ranked = keyword_counts(docs, key, text, thresholds).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= thresholds.top_keywords)
    return ranked.select(key, "rank", "keyword", "n", (F.col("n") * 100.0 / F.col("total")).alias("density"))


def stuffed_keywords(docs: DataFrame, key: str = "doc_id", text: str = "text", thresholds: Thresholds = DEFAULTS) -> DataFrame:
    return top_keywords(docs, key, text, thresholds).filter(F.col("density") > thresholds.stuffing_percent)


def quality_summary(measured: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means, the most frequent grade (the first by name of equally frequent ones) and counts of weak texts."""
    return measured.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pages"),
        F.avg("score").alias("avg_score"),
        F.avg("words").alias("avg_words"),
        F.avg("sentences").alias("avg_sentences"),
        F.mode("grade", True).alias("grade"),
        F.count_if(F.col("score") < 50).alias("hard_pages"),
        F.count_if(F.col("words") < 300).alias("thin_pages"),
    )
