"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet to the
shared checkpoint folder and read again as the next stage's documents, so a lost executor costs tasks of
one stage only; :func:`run` deletes a result once the next one is written, and what a stage cut on its way. An empty table goes through all of them; further columns pass through all but the last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import op1_decontaminate, op4_simhash, op5_pii, op7_mixing, op10_quality
from codeloom.llm.common import drop, ensure_checkpoints, scratch, small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go; repeated rows are judged alike."""
    small_batches(spark)
    return op10_quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id, of equal ones the smallest hash of the text.

    Rows without a doc_id all stay, as do different texts under one doc_id; of rows that repeat both one stays.
    """
    small_batches(spark)
    return op4_simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts or items match nothing."""
    small_batches(spark)
    return op1_decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data, null and empty texts as they are; n_chars is set anew."""
    small_batches(spark)
    return op5_pii.clean(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, with its text and language. Null sources are one source."""
    small_batches(spark)
    return op7_mixing.mix(docs, keep=["text", "lang"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

#: Fingerprints, vote statistics and keyed surrogates have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ensure_checkpoints(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        with scratch(spark):  # what a stage cuts goes when its result is written
            stage(spark, docs, sf_dir).write.parquet(path := f"{base}/{k}-{name}")
        if before:
            drop(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
