"""Corpus preparation: documents in, packed training sequences out.

Each stage is one operator of ``lodestar.llm``, works on all that its predecessor kept and returns the
columns of ``documents``; the last returns a row per packed piece.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import exact_dedup, near_dup, packing, pii, quality
from lodestar.llm._common import stored


BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def _bounded(spark: SparkSession) -> None:
    """Rows go to Python workers at most ``ROWS`` at a time: executors that run all stages hold less memory outside of the heap."""
    if int(spark.conf.get(BATCH)) > ROWS:
        spark.conf.set(BATCH, str(ROWS))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts; it learns from the labels of the documents at hand."""
    _bounded(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.fit(docs, labels))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of equal texts."""
    return exact_dedup.exact_dedup(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of texts linked by a similarity of 0.8 or more."""
    _bounded(spark)
    return near_dup.near_dedup(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` counts the new texts."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row per piece."""
    _bounded(spark)
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # the classifier and the packing have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result stored in the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, last = STAGES
    kept = reduce(lambda d, stage: stored(stage[1](spark, d, sf_dir), stage[0]), first, docs)
    return last[1](spark, kept, sf_dir)
