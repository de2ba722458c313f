"""Sorts and top-k reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TooFewRowsError(ValueError):
    """Fewer rows than requested."""


def path_key(path: Column) -> Column:
    """Sort key comparing paths component by component."""
    return F.split(path, "/")


def order_by_path(df: DataFrame, path: str = "path") -> DataFrame:
    return df.orderBy(path_key(F.col(path)))


def top_k(
    df: DataFrame, col: str, k: int, tie: Sequence[str | Column], descending: bool = False
) -> DataFrame:
    """The k smallest or largest rows, NULLs last, ties broken by ``tie``."""
    c = F.col(col)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *tie).limit(k)


def top_abs(df: DataFrame, col: str, tie: Sequence[str], k: int | None = None) -> DataFrame:
    """Rows by falling magnitude, optionally the first k."""
    ordered = df.orderBy(F.abs(F.col(col)).desc_nulls_last(), *tie)
    return ordered if k is None else ordered.limit(k)


def take_exact(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first n rows; an error when there are fewer."""
    found = df.limit(n).count()
    if found < n:
        raise TooFewRowsError(f"requested {n} rows but found only {found}")
    return df.orderBy(*order).limit(n)
