"""Corpus preparation: five stages over documents, each written and read again before the next.

language     drops documents that are in no language: no letter, or no language covers a third of the letters
exact_dedup  keeps of equal texts the row with the largest doc_id
near_dedup   keeps of each component of near copies the row with the smallest doc_id
personal     replaces personal data in the texts; every document stays
packing      cuts the documents into pieces of packed sequences
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm import exact_dedup, jaccard, langid, packing, pii
from parley.llm.common import scratch_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.drop_unknown(docs, langid.learn(langid.teachers(docs)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_unique(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("personal", personal), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Components, trained languages and tokens are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None
