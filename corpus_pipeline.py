"""A corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

Each stage reads all that the one before it kept. All but the last return the columns of
``documents``; the last returns packed pieces with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankspark.llm import exact_dedup, langid, mixing, packing, simhash
from rankspark.llm.common import cut, release


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those predicted `und` (no text, no letter) go."""
    return langid.in_a_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each set of equal texts, the one with the smallest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate takes it."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids, with their ids."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash", near), ("mixing", mixture), ("packing", packed)]

#: SimHash's 64-bit XXH64 votes, learned languages and token ids are beyond SQL; tests hold
#: the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read
    again. A stage's table is deleted as soon as the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(*before)
        before = [docs]
    packed_ = STAGES[-1][1](spark, docs, sf_dir)
    release(*before)  # packing reads its own table of ids from here on
    return packed_
