"""Unions, wide-to-long and long-to-wide."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.scalars import volume_column
from cohortloom.operators.quality import assert_unique


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def wide_to_long(
    df: DataFrame,
    ids: Sequence[str],
    columns: dict[str, str],
    variable: str,
    value: str,
    check: bool = True,
    drop_null: bool = True,
) -> DataFrame:
    """One row per id and column; ``columns`` maps the new variable's value to a column name."""
    if check:
        assert_unique(df, [ids[0]])
    renamed = df.select(*ids, *[F.col(f"`{c}`").alias(v) for v, c in columns.items()])
    long = renamed.unpivot(list(ids), list(columns), variable, value)
    return long.filter(F.col(value).isNotNull()) if drop_null else long


def unpivot_scores(df: DataFrame, key: str, name: str = "score", value: str = "value") -> DataFrame:
    """Every column but the key as (name, value) rows."""
    scores = [c for c in df.columns if c != key]
    return df.unpivot([key], scores, name, value)


def long_to_wide(
    df: DataFrame, key: Sequence[str], category: str, value: str, categories: Sequence[str], check: str = "now"
) -> DataFrame:
    """One column per listed category; a repeated (key, category) is an error.

    ``check`` says when: ``now``, by a job of its own; ``later``, in the plan, whose action then fails. The latter
    shuffles once, by the key.
    """
    if check == "now":
        assert_unique(df, [*key, category])
        return df.groupBy(*key).pivot(category, list(categories)).agg(F.first(value))
    if check != "later":
        raise ValueError(f"check must be now or later, not {check}")
    columns = []
    for c in categories:
        here = F.col(category) == F.lit(c)
        message = F.concat(F.lit(f"{category} {c} repeats for "), F.to_json(F.struct(*key)))
        only = F.first(F.when(here, F.col(value)), ignorenulls=True)
        columns.append(F.when(F.count_if(here) > 1, F.raise_error(message)).otherwise(only).alias(str(c)))
    return df.groupBy(*key).agg(*columns)


def normalize_by_reference(
    df: DataFrame, key: Sequence[str], category: str, value: str, reference: str, name: str = "ratio"
) -> DataFrame:
    """Each category's share of the key's reference category, which itself is left out.

    (key, category) is unique, so a key's group is no larger than the list of categories.
    """
    base = F.max(F.when(F.col(category) == reference, F.col(value))).over(Window.partitionBy(*key))
    ratio = F.try_divide(F.col(value), base)
    return df.withColumn(name, ratio).filter(F.col(category) != reference)


def assemble(
    df: DataFrame, key: Sequence[str], category: str, value: str, name: str = "features"
) -> DataFrame:
    """Long rows as one array per key, in category order; group size is the number of categories."""
    pair = F.struct(F.col(category).alias("c"), F.col(value).cast("double").alias("v"))
    return df.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["v"]).alias(name)
    )


def volume_names(df: DataFrame, category: str = "region") -> DataFrame:
    return df.withColumn("feature", volume_column(F.col(category)))


def in_order(df: DataFrame, tail: Sequence[str]) -> DataFrame:
    """All columns, the fixed tail last."""
    return df.select(*[c for c in df.columns if c not in tail], *tail)


def constant(df: DataFrame, **values: str) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def array_of(columns: Sequence[str | Column], name: str = "features") -> Column:
    """Feature columns in a fixed order as one array."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.array(*[c.cast("double") for c in cols]).alias(name)
