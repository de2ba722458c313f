"""Pieces that several operators share: words, lines, documents and stored intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.session import materialize

# Fixed: the white space of the result contracts, as a regular expression and as characters.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Stands for a missing doc_id where rows are ordered or joined: before every other id.
NO_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text, an empty array for none."""
    trimmed = F.trim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def key_of(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later jobs and lost executors start from the table."""
    return materialize(df, f"llm-{name}", compression="zstd")


def python_lower(text: str) -> str:
    """Lower-case A-Z only."""
    return text if text.islower() else text.translate(_LOWER)


_LOWER = str.maketrans(UPPER, LOWER)
