"""Exact duplicates by content-defined chunk recipes, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A chunk ends at the first sentence or line end after MIN_CHUNK characters; where there is none up to MAX_CHUNK, behind
#: the first white space; where there is none of it, behind the first eight characters in a row of about half of all
#: letters and signs; and only without these at MAX_CHUNK.  Where it ends depends on the text around, not on offsets,
#: so an insertion changes only the chunks near it.
MIN_CHUNK, MAX_CHUNK = 512, 4096
#: About half of the characters of unspaced text: encoded data, Han, kana, Hangul, Thai.
_HALF = r"[A-Ma-m0-4+\x{3040}-\x{309F}\x{4E00}-\x{6AFF}\x{AC00}-\x{C3FF}\x{0E01}-\x{0E20}]"


def chunk_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> str:
    ends = (r"(?:[.!?]\s|[。！？\n])", r"\s", rf"{_HALF}{{8}}")
    return "(?s)" + "|".join(rf".{{{least},{most - 8}}}?{end}" for end in ends) + rf"|.{{1,{most}}}"


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The chunks of a text in order; joined, they are the text.  An empty text has none."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(least, most)), F.lit(0))


def chunk_recipes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recipes, dictionary).

    ``recipes``: row, doc_id, text_sha256, bytes, recipe - the ordered chunk identifiers of every row.
    ``dictionary``: id, sha, bytes, mix, occurrences - every distinct chunk once.

    Texts are read once and never shuffled: a chunk is known by its SHA-256, and an identifier is given only where
    its byte length and an independent 64-bit hash agree as well; occurrences that differ in either get identifiers
    of their own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marks = F.transform(chunks(text), lambda c: F.struct(F.unhex(F.sha2(c, 256)).alias("sha"), F.octet_length(c).alias("bytes"), F.xxhash64(c).alias("mix")))
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(text, 256).alias("text_sha256"), F.octet_length(text).alias("bytes"), marks.alias("marks")), "chunks")
    uses = rows.select("row", F.posexplode("marks").alias("pos", "mark")).select("row", "pos", "mark.*")
    counted = uses.groupBy("sha", "bytes", "mix").agg(F.count(F.lit(1)).alias("occurrences"))
    dictionary = materialize(counted.withColumn("id", F.monotonically_increasing_id()), "chunk-ids")
    ordered = uses.join(dictionary.select("sha", "bytes", "mix", "id"), ["sha", "bytes", "mix"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("ids"))
    recipe = F.coalesce(F.transform("ids", lambda x: x["id"]), F.array().cast("array<bigint>"))
    return rows.drop("marks").join(ordered, "row", "left").select("row", "doc_id", "text_sha256", "bytes", recipe.alias("recipe")), dictionary


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id, text).

    Rows are equal when their ordered identifier lists are.  The row with the largest doc_id stays; of rows that
    share it, one.  Null texts count as empty, and empty texts equal each other; null ids come last; repeated rows
    each give a row; an empty table gives none; further columns are ignored.
    """
    recipes, _ = chunk_recipes(docs)
    recipes = materialize(recipes, "recipes")
    # written, so that the join deals both sides anew and a hot group's rows can be split
    groups = materialize(recipes.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    return recipes.join(groups, "recipe").select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")
