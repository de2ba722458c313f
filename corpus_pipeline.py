"""The corpus pipeline: documents in, packed training sequences out.

Quality rules drop documents, line dedup and suffix-array dedup cut repeated text out of them, the Jaccard
join keeps one of each group of near copies, and best-fit packing lays what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import jaccard_join, line_dedup, packing, quality_rules, suffix_dedup
from cohortloom.llm.shared import documents, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines."""
    return line_dedup.clean(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without long repeated strings."""
    return suffix_dedup.clean(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences."""
    return packing.sequences(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_copies),
    ("suffix_dedup", repeats),
    ("best_fit_packing", sequences),
]
#: Suffix arrays and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
