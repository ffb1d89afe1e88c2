"""A training-data pipeline over `documents`: quality rules, near duplicates, repeated passages, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's result as Parquet in the
shared folder and gives it to the next one. All stages but the last return the columns of `documents`. A stage's result
is to be written before the next stage is called, which deletes the tables that the one before it worked with.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathwise.llm import bpe_codec, jaccard_join, mixing, quality_rules, suffix_dedup
from pathwise.llm.common import delete_tables, left_tables, table, written

#: Bytes of a passage that may not stand in the corpus twice: those of about fifty short words.
PASSAGE_BYTES = 240

#: Tables of the stage that was called last.
_USED: list[str] = []


def _stage(function):
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete_tables(spark, _USED)
        before = left_tables()
        out = function(spark, docs, sf_dir)
        _USED[:] = [x for x in left_tables() if x not in before]
        return out

    return run_stage


@_stage
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host passes."""
    return quality_rules.keep_documents(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard_join.drop_near_duplicates(docs)


@_stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand elsewhere, too; documents without a word left go."""
    return suffix_dedup.remove_repeats(docs, PASSAGE_BYTES).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in the proportions of their weights, a document as often as the mix takes it."""
    return mixing.mix_documents(docs)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and whether they decode to the text, for every row."""
    encoded = bpe_codec.round_trip(docs)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", rules), ("n-gram jaccard join", near_duplicates), ("suffix-array dedup", repeats), ("mix sources", mix), ("byte-level bpe", tokens)]

#: SQL can't express the stages (suffix arrays, hashed trees, merges by rank); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0])
        delete_tables(spark, last)
        last = left_tables()[-1:]
    return docs
