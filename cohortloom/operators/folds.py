"""Grouped k-fold: whole groups per fold, balanced by size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.operators.joins import attach_group
from cohortloom.operators.positions import with_position
from cohortloom.session import materialize


def lightest_first(classes: list[tuple[int, int]], k: int) -> dict[int, list[int]]:
    """How many groups of each size every fold takes when each goes to the lightest fold.

    ``classes`` lists (size, how many groups).  Groups of one size are interchangeable, so instead
    of walking them one by one the common fill level is searched, size by size, largest first.
    """
    loads = [0] * k
    quotas = {}
    for size, count in sorted(classes, reverse=True):

        def taken(level: int) -> list[int]:
            return [max(0, -((load - level) // size)) for load in loads]

        low, high = min(loads), max(loads) + size * (count + 1)
        while high - low > 1:
            mid = (low + high) // 2
            if sum(taken(mid)) < count:
                low = mid
            else:
                high = mid
        quota = taken(low)
        rest = count - sum(quota)
        for i in range(k):
            if rest and loads[i] + size * quota[i] == low:
                quota[i] += 1
                rest -= 1
        loads = [load + size * q for load, q in zip(loads, quota)]
        quotas[size] = quota
    return quotas


def assign_groups(sizes: DataFrame, group: str, size: str, k: int, name: str = "fold") -> DataFrame:
    """Group, size and fold (1..k) from a table of group sizes.

    The driver sees one row per distinct size.  Sizes add up to the row count N, so there are at
    most sqrt(2 N) of them.
    """
    classes = [
        (r["s"], r["c"])
        for r in sizes.groupBy(F.col(size).alias("s")).agg(F.count(F.lit(1)).alias("c")).collect()
    ]
    k = max(1, min(k, sum(c for _, c in classes)))
    rows = []
    for s, quota in lightest_first(classes, k).items():
        bounds, seen = [], 0
        for q in quota:
            seen += q
            bounds.append(seen)
        rows.append((s, bounds))
    schema = T.StructType(
        [T.StructField("_size", T.LongType()), T.StructField("_bounds", T.ArrayType(T.LongType()))]
    )
    table = sizes.sparkSession.createDataFrame(rows, schema)
    ranked = with_position(
        sizes.select(group, F.col(size).cast("long").alias("_size")), [group], ["_size"], "_rank"
    )
    placed = attach_group(ranked, table, ["_size"], "inner")
    fold = F.size(F.filter("_bounds", lambda b: b < F.col("_rank"))) + 1
    return placed.select(group, F.col("_size").alias(size), fold.cast("int").alias(name))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("_n_rows"))


def group_kfold(df: DataFrame, group: str, k: int, name: str = "fold") -> DataFrame:
    """Append the fold of each row's group; ``k`` is lowered to the number of groups."""
    folds = materialize(assign_groups(group_sizes(df, group), group, "_n_rows", k, name), "groups")
    return attach_group(df, folds.drop("_n_rows"), [group], "inner")
