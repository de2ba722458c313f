"""Small scalar helpers on numeric and text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS_PER_YEAR = 12.0


def megabytes(c: Column) -> Column:
    return c / F.lit(1e6)


def cubic_centimetres(c: Column) -> Column:
    return c / F.lit(1e3)


def clip_upper(c: Column, hi: float) -> Column:
    """``min(c, hi)``, NULL staying NULL (``least`` alone would return ``hi``)."""
    return F.when(c.isNotNull(), F.least(c, F.lit(hi)))


def years_to_months(c: Column) -> Column:
    return c * F.lit(MONTHS_PER_YEAR)


def months_to_years(c: Column) -> Column:
    return c / F.lit(MONTHS_PER_YEAR)


def volume_column(region: Column) -> Column:
    """Column-style name of a region volume."""
    return F.concat(F.lit("volume__"), region)


def feature_label(name: Column, feature_set: str) -> Column:
    """Display label of a ``volume__…`` name: a ratio to the reference or an absolute volume."""
    bare = F.regexp_replace(name, "volume__", "")
    if feature_set == "icv-normalized":
        return F.concat(F.trim(bare), F.lit(" / TIV"))
    if feature_set == "raw":
        return F.concat(bare, F.lit(" (mm^3)"))
    raise ValueError(f"unknown feature set {feature_set!r}")


def with_errors(df: DataFrame, y: str, yhat: str, prefix: str = "") -> DataFrame:
    """Append the signed error ``yhat - y`` and its absolute value."""
    err = F.col(yhat) - F.col(y)
    return df.withColumns({f"{prefix}error": err, f"{prefix}absolute_error": F.abs(err)})


def pick_by(key: Column, choices: dict[str, Column]) -> Column:
    """The column chosen by the value of ``key``; NULL for any other value."""
    out = None
    for value, c in choices.items():
        out = F.when(key == value, c) if out is None else out.when(key == value, c)
    return out
