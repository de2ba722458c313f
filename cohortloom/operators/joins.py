"""Keyed joins with checked cardinality; a hot left key can be spread over several tasks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.operators.quality import assert_unique, unique_in_plan
from cohortloom.session import materialize


def keyed_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", spread: int = 1
) -> DataFrame:
    """Equi-join: inner, left, left_semi or left_anti.

    Catalyst broadcasts a right side that it knows to be small in bytes, and AQE splits the partitions
    of hot keys.  It cannot split what earlier steps have already gathered by the key, for there is no
    shuffle left to split: with ``spread`` above 1 every left row gets a salt, a hash of its other
    columns, and each right row is copied once per salt.  That holds for any number of hot keys, and is
    meant for right sides with few rows for a key.
    """
    on = list(on)
    if spread <= 1:
        return left.join(right, on, how)
    maps = {f.name for f in left.schema.fields if isinstance(f.dataType, T.MapType)}
    rest = [c for c in left.columns if c not in on and c not in maps]
    salt = F.pmod(F.xxhash64(*rest), F.lit(spread)) if rest else F.lit(0).cast("long")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)).cast("array<bigint>")))
    return left.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")


def attach_group(
    df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left"
) -> DataFrame:
    """Attach the values of a per-group table to the rows of each group.

    The table is written first, so that Catalyst knows its size when it plans the join: a small one is broadcast
    and the rows stay where they are. Left to AQE they are dealt by the group before the size is known, and with
    few groups AQE takes the broadcast back, for most partitions are empty: a task then reads a whole group.
    """
    return keyed_join(df, materialize(table, "groups"), on, how)


def join_m1(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    match_flag: str | None = None,
    check: str = "now",
) -> DataFrame:
    """Many-to-one join: raises when a key occurs twice on the right.

    ``check`` says when: ``now``, by a job of its own; ``later``, in the plan of the join, whose action
    then fails; ``none`` if the key is known to be unique, for instance after grouping by it.
    ``match_flag`` names an extra boolean column telling whether a right row was found.
    """
    right = checked_unique(right, on, check)
    if match_flag:
        right = right.withColumn(match_flag, F.lit(True))
    out = keyed_join(left, right, on, how)
    return out.withColumn(match_flag, F.coalesce(match_flag, F.lit(False))) if match_flag else out


def checked_unique(df: DataFrame, on: Sequence[str], check: str) -> DataFrame:
    if check not in ("now", "later", "none"):
        raise ValueError(f"check must be now, later or none, not {check}")
    return unique_in_plan(df, on) if check == "later" else assert_unique(df, on) if check == "now" else df


def join_11(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", check: str = "now"
) -> DataFrame:
    """One-to-one join; both sides must be unique on the key. ``check`` as in :func:`join_m1`."""
    left, right = checked_unique(left, on, check), checked_unique(right, on, check)
    return left.join(right, list(on), how)


def lookup(
    df: DataFrame, table: DataFrame, on: Sequence[str], value: str, check: str = "now"
) -> DataFrame:
    """Inner lookup: rows without a match, or with a NULL value, are dropped."""
    table = checked_unique(table, on, check)
    return keyed_join(df, table.filter(F.col(value).isNotNull()), on, "inner")


def lookup_with_reasons(
    df: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    value: Column,
    matched: Column,
    reasons: tuple[Column, Column, Column],
    check: str = "now",
) -> DataFrame:
    """Lookup that says why a row failed, first cause first.

    ``matched`` is the name-pattern test and ``value`` an expression over the joined row; ``reasons``
    are the messages for no pattern match, key not in the table, and value missing.  Good rows have
    a NULL ``reason``.
    """
    found = join_m1(df, table, on, "left", match_flag="_found", check=check)
    return found.withColumn(
        "reason",
        F.when(~matched, reasons[0])
        .when(~F.col("_found"), reasons[1])
        .when(value.isNull(), reasons[2]),
    ).drop("_found")


def exclude(df: DataFrame, listed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Drop rows whose key is listed; NULL keys stay."""
    return keyed_join(df, listed.select(*on).distinct(), on, "left_anti")


def semi(df: DataFrame, listed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keep rows whose key is listed."""
    return keyed_join(df, listed.select(*on).distinct(), on, "left_semi")


def pair_files(left: DataFrame, right: DataFrame, derived: Column, name: str) -> DataFrame:
    """Inner match of ``left`` to the ``right`` row whose ``name`` equals a derived name."""
    out = left.withColumn("_sibling", derived)
    other = right.withColumnRenamed(name, "_sibling")
    return keyed_join(out, other, ["_sibling"], "inner").withColumnRenamed("_sibling", name)


def coverage(joined: DataFrame, matched: str, cols: Sequence[str]) -> DataFrame:
    """One row: rows, matched rows, non-null count and rate of each column, and of all together."""
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(matched)).alias("n_matched")]
    for c, test in [*[(c, F.col(c).isNotNull()) for c in cols], ("all", full)]:
        aggs.append(F.count_if(test).alias(f"n_{c}"))
        aggs.append(F.avg(test.cast("double")).alias(f"rate_{c}"))
    return joined.agg(*aggs)


def attach_predictions(labels: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Labels with their predictions, matched by key and unique on both sides."""
    return join_11(labels, predictions, [key], "inner")


def lookup_or_hash(df: DataFrame, table: DataFrame, label: str, value: str) -> DataFrame:
    """Attribute of a label; unknown labels get a default in 50..254 from their digest, label 0 gets 0."""
    found = attach_group(df, table.select(label, value), [label])
    digest = F.conv(F.substring(F.md5(F.col(label).cast("string").cast("binary")), 1, 8), 16, 10)
    default = F.when(F.col(label) == 0, F.lit(0)).otherwise(
        (F.lit(50) + digest.cast("long") % 205).cast("int")
    )
    return found.withColumn(value, F.coalesce(F.col(value), default))
