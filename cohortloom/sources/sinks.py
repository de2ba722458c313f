"""CSV and nested JSON output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.missing import nan_to_null


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, which CSV can hold."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str, **options) -> None:
    """CSV with a header line per part file."""
    flat_for_csv(df).write.option("header", True).option("escape", '"').options(**options).csv(path)


def _has_float(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_float(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_float(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_float(kind.valueType)
    return isinstance(kind, (T.DoubleType, T.FloatType))


def _nan_free(c: Column, kind: T.DataType) -> Column:
    """``c`` with NULL for every NaN in it, at any depth."""
    if not _has_float(kind):
        return c
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_nan_free(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _nan_free(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: _nan_free(x, kind.valueType))
    return nan_to_null(c)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as NULL, in nested values too: JSON has no NaN."""
    return df.withColumns(
        {f.name: _nan_free(F.col(f.name), f.dataType) for f in df.schema.fields if _has_float(f.dataType)}
    )


def write_report(df: DataFrame, path: str) -> None:
    """Nested report rows as JSON lines; NULL fields are written as null."""
    without_nan(df).write.option("ignoreNullFields", "false").json(path)
