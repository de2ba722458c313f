"""One ingest-time rule for missing values: NULL, never NaN and never a token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.config import MISSING_TOKENS


def token_to_null(c: Column) -> Column:
    """NULL for text that spells a missing value."""
    return F.when(~c.isin(*MISSING_TOKENS), c)


def nan_to_null(c: Column) -> Column:
    """NULL for NaN, which Spark would order above every number."""
    return F.when(~F.isnan(c), c)


def normalize_missing(df: DataFrame) -> DataFrame:
    """Apply both rules to every text and floating-point column in one projection."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            c = token_to_null(c)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = nan_to_null(c)
        out.append(c.alias(field.name))
    return df.select(*out)
