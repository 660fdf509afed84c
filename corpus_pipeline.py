"""Corpus pipeline: language ID, exact and near deduplication, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from examlytics.llm import decontaminate, exact_dedup, language_id, minhash_dedup, packing
from examlytics.session import scratch_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and a language found."""
    return language_id.drop_unknown(docs)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


#: Shingle similarity from which the near-duplicate stage links, in per cent (op3 has 85).
NEAR_PERCENT = 80


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, linked at NEAR_PERCENT and above."""
    return minhash_dedup.keep_one(docs, percent=NEAR_PERCENT)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and their places."""
    return packing.pack(docs, packing.byte_bpe())


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", no_copies),
    ("minhash_near_dedup", no_near_copies),
    ("benchmark_decontamination", no_benchmark),
    ("best_fit_packing", packed),
]

#: The trained classifier and the components cannot be expressed in SQL: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
