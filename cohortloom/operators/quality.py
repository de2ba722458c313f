"""Reject channels and key checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class DuplicateKeyError(ValueError):
    """A key that must be unique occurs more than once."""


class MissingColumnError(ValueError):
    """A table lacks a required column."""


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count; NULL keys count as equal."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], samples: int = 5) -> DataFrame:
    """Raise with a few samples when a key repeats; otherwise return ``df`` unchanged."""
    bad = key_violations(df, keys).take(samples)
    if bad:
        shown = ", ".join(str(tuple(r)) for r in bad)
        raise DuplicateKeyError(f"keys {list(keys)} repeat, for example {shown}")
    return df


def unique_in_plan(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``, whose evaluation fails when a key repeats: no job of its own, and one exchange by the key."""
    rest = [c for c in df.columns if c not in keys]
    row = F.first(F.struct(*rest)) if rest else F.first(F.lit(True))
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), row.alias("_row"))
    message = F.concat(F.lit(f"keys {list(keys)} repeat, for example "), F.to_json(F.struct(*keys)))
    once = counted.withColumn("_row", F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.col("_row")))
    return once.select(*[c if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns])


def with_reasons(
    df: DataFrame, rules: Sequence[tuple[Column, Column | str]], name: str = "reject_reason"
) -> DataFrame:
    """Append the message of the first rule a row breaks; rules are ``(must hold, message)``.

    A rule that is NULL counts as broken.
    """
    out = F.lit(None).cast("string")
    for holds, message in reversed(rules):
        text = F.lit(message) if isinstance(message, str) else message
        out = F.when(~F.coalesce(holds, F.lit(False)), text).otherwise(out)
    return df.withColumn(name, out)


def split_valid(
    df: DataFrame,
    rules: Sequence[tuple[Column, Column | str]] | None = None,
    name: str = "reject_reason",
) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejected rows with their reason; together they are the input."""
    judged = df if rules is None else with_reasons(df, rules, name)
    good = judged.filter(F.col(name).isNull()).drop(name)
    return good, judged.filter(F.col(name).isNotNull())


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumnError(f"missing columns {missing}")
    return df


@dataclass(frozen=True)
class Divided:
    """Stored good and rejected rows, and how many there are of each kind."""

    good: DataFrame
    bad: DataFrame
    n_rows: int
    n_good: int
    reasons: dict[str, int]
    masks: dict[str, int]

    @property
    def failed(self) -> bool:
        """Whether any row was rejected."""
        return self.n_good < self.n_rows

    def counts(self) -> DataFrame:
        """``reason, n``: a row for each rule, those that no row breaks included."""
        return self.good.sparkSession.createDataFrame(list(self.reasons.items()), "reason string, n long")


def divide(
    df: DataFrame,
    rules: Sequence[tuple[Column, str]],
    path: str,
    masks: dict[str, Column] | None = None,
    name: str = "reject_reason",
) -> Divided:
    """Write good rows and rejects below ``path`` and count both on the way, in one job and one scan.

    ``rules`` are ``(must hold, message)``; the first one that a row breaks is its reason, and rules of one
    message are counted together. ``masks`` are conditions to be counted over all rows, NULL counts as not covered.
    The counts are observed while the rows are written: nothing is read again for them.
    """
    masks = masks or {}
    messages = list(dict.fromkeys(m for _, m in rules))
    judged = with_reasons(df, rules, name)
    seen = Observation()
    observed = judged.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(name).isNull()).alias("good"),
        *[F.count_if(F.col(name) == m).alias(f"r{i}") for i, m in enumerate(messages)],
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"m{i}") for i, c in enumerate(masks.values())],
    )
    observed.withColumn("valid", F.col(name).isNull()).write.partitionBy("valid").parquet(path)
    got = seen.get
    spark = df.sparkSession
    stored = spark.read.schema(judged.withColumn("valid", F.lit(True)).schema).parquet(path)
    return Divided(
        stored.filter("valid").drop(name, "valid"),
        stored.filter("not valid").drop("valid"),
        got["rows"],
        got["good"],
        {m: got[f"r{i}"] for i, m in enumerate(messages)},
        {m: got[f"m{i}"] for i, m in enumerate(masks)},
    )
