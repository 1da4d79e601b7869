"""Corpus pipeline: each stage works on all rows that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pseudoflow.llm import exact_dedup, packing, pii, quality_classifier, simhash
from pseudoflow.llm.common import read, written


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.keep_good(docs, read(spark, sf_dir, "labels"))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.deduplicate(docs)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays: 3-word shingles, 2 bits."""
    return simhash.deduplicate(docs, shingle=3, bits=2)


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the text; n_chars follows it."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", stage_quality),
    ("exact_dedup", stage_exact_dedup),
    ("simhash_near_dedup", stage_near_dedup),
    ("pii", stage_pii),
    ("best_fit_packing", stage_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Models and tokenizers take part: SQL can't express it.
ORACLE_SQL = None
