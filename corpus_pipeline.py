"""A training corpus from ``documents``, in five stages.

Every stage takes what its predecessor kept, as written and read again: toxic documents go, one document of each
SimHash component stays, contaminated documents go, the rest is mixed to the source weights (a document may come
twice, and the one that the budget cuts in a source is shortened), and what was mixed is written as token files.

Null and empty texts pass the three filters and are never mixed, so they are in no token file; rows that repeat id and
text are one after the second stage; ids may be null or repeat; columns beside doc_id, text and source are carried along
whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitegrain.llm import common, decontaminate, mixing, queries, simhash, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row but those that score as toxic."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of every SimHash component; rows without an id come last."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row but those whose text is contaminated."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every turn that a document gets in the mix; rows without words get none."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mix as token files and reads back a row for each of its rows."""
    return token_files.token_digest(docs, queries.tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", one_of_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_output", token_output),
]

#: Fingerprints, learned scores and tokens have no SQL; the pipeline is tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents`` table.

    What a stage writes on its way goes when its result is written, and that result when the next one is: of the
    corpus there are two copies at most beside the token files, which stay.
    """
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = common.scratch_path(spark, f"pipeline-{name}", kept=True)
        with common.scratch_run(spark):
            kept = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", path)
        common.discard(docs)
        docs = kept
    return docs
