"""Exact positions and running totals over a total order, without one task holding a group.

A window that is unpartitioned, or partitioned by a key that may hold a third of all rows, sorts
that whole group in one task.  Here the input is written once and, when it has more than
``RANGE_ROWS`` rows, dealt into that many times fewer ranges of (group, order) and written as such:

1. Spark samples the keys for the range bounds; every row is kept and carries the number of its range,
2. rows are numbered inside (group, range), and
3. the sizes of the group's earlier ranges, pre-aggregated before any shuffle, are added.

The number of ranges grows with the rows, so a task holds about ``RANGE_ROWS`` rows at any size, whether
they belong to one group or to millions of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import materialize

#: Rows that one task numbers.
RANGE_ROWS = 1_000_000


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    weights: dict[str, Column],
    by: Sequence[str] = (),
    totals: bool = True,
    range_rows: int = RANGE_ROWS,
    written: bool = False,
) -> DataFrame:
    """Inclusive running sums of ``weights`` along ``order`` within ``by``, with group totals.

    ``order`` must be a total order within ``by``.  Each weight ``w`` gives the columns ``w`` (the
    running sum) and, with ``totals``, ``w_total``.  ``written`` says that ``df`` is a stored table,
    which need not be written again.
    """
    by, order, names = list(by), list(order), list(weights)
    stored = df if written else materialize(df, "order")
    placed = stored.withColumns({f"_w_{n}": F.coalesce(c, F.lit(0)) for n, c in weights.items()})
    ranges = -(-stored.count() // range_rows)
    if ranges > 1:
        dealt = placed.repartitionByRange(ranges, *by, *[c for c in order if c not in by])
        placed = materialize(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    else:
        placed = placed.withColumn("_range", F.lit(0))

    cell = [*by, "_range"]
    within = Window.partitionBy(*cell)
    upto = within.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({n: F.sum(f"_w_{n}").over(upto) for n in names})
    if totals:
        out = out.withColumns({f"{n}_total": F.sum(f"_w_{n}").over(within) for n in names})
    scratch = ["_range", *[f"_w_{n}" for n in names]]
    if ranges <= 1:
        return out.drop(*scratch)

    # Ranges follow the group order, so at most one group is split by each bound: the groups in several
    # ranges have at most two rows here for each range.
    sizes = placed.groupBy(*cell).agg(*[F.sum(f"_w_{n}").alias(f"_s_{n}") for n in names])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    split = (
        sizes.withColumn("_parts", F.count(F.lit(1)).over(group))
        .withColumns({f"_o_{n}": F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)) for n in names})
        .withColumns({f"_t_{n}": F.sum(f"_s_{n}").over(group) for n in names})
        .filter("_parts > 1")
        .select(
            *[F.col(c).alias(f"_k_{c}") for c in cell],
            *[f"_o_{n}" for n in names],
            *[f"_t_{n}" for n in names],
        )
    )
    match = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in cell]
    out = out.join(split, match, "left")
    out = out.withColumns({n: F.col(n) + F.coalesce(F.col(f"_o_{n}"), F.lit(0)) for n in names})
    if totals:
        out = out.withColumns({f"{n}_total": F.coalesce(f"_t_{n}", f"{n}_total") for n in names})
    scratch += [f"_k_{c}" for c in cell]
    scratch += [f"_{x}_{n}" for x in "ot" for n in names]
    return out.drop(*scratch)


def with_position(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    name: str = "position",
    total: str | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """1-based position along a total order within ``by``; optionally the group size."""
    one = F.lit(1).cast("long")
    out = running_totals(df, order, {name: one}, by, total is not None, range_rows)
    return out.withColumnRenamed(f"{name}_total", total) if total else out


def batch_slice(df: DataFrame, order: Sequence[str], batch_id: int, size: int) -> DataFrame:
    """Rows ``[batch_id*size, batch_id*size + size)`` of the ordered table."""
    start = batch_id * size
    ranked = with_position(df, order, name="_pos")
    return ranked.filter(F.col("_pos").between(start + 1, start + size)).drop("_pos")


def _div(a: Column, b: Column) -> Column:
    """Integer quotient."""
    return F.call_function("div", a, b)


def fold_of(position: Column, total: Column, k: int) -> Column:
    """Contiguous fold (1..k) of a 1-based position; the first ``total mod k`` folds hold one more."""
    size = _div(total, F.lit(k))
    wide = total % F.lit(k) * (size + 1)
    p = position - 1
    late = total % F.lit(k) + _div(p - wide, F.greatest(size, F.lit(1)))
    return F.when(p < wide, _div(p, size + 1)).otherwise(late).cast("int") + 1


def kfold(df: DataFrame, k: int, order: Sequence[str], name: str = "fold") -> DataFrame:
    """Contiguous k-fold split along ``order``."""
    ranked = with_position(df, order, name="_pos", total="_n")
    return ranked.withColumn(name, fold_of(F.col("_pos"), F.col("_n"), k)).drop("_pos", "_n")


def value_runs(
    df: DataFrame, value: str, by: Sequence[str] = (), range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Distinct values with their running count, per group: ``(by, value, n, upto, upto_total)``.

    NULL and NaN values are left out.  Counting comes first, so copies of a value never travel.
    """
    kept = df.filter(F.col(value).isNotNull())
    if dict(kept.dtypes)[value] in ("double", "float"):
        kept = kept.filter(~F.isnan(value))
    counts = kept.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "values")
    return running_totals(counts, [value], {"upto": F.col("n")}, by, range_rows=range_rows, written=True)


def ecdf(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "fraction") -> DataFrame:
    """Sorted-value curve: for each distinct value the share of rows not above it, per series."""
    runs = value_runs(df, value, by)
    return runs.select(*by, value, (F.col("upto") / F.col("upto_total")).alias(name))


def curve(
    df: DataFrame, value: str, by: Sequence[str] = (), points: int = 101, k: int = 800, name: str = "fraction"
) -> DataFrame:
    """Sorted-value curve at ``points`` fixed fractions from 0 to 1 per series: ``by, fraction, value``.

    Each task builds one mergeable KLL sketch per series, a few kilobytes whatever the number of rows, and only
    sketches are shuffled. The rank of a reported value differs from its fraction by at most :func:`rank_error` of
    ``k`` with 99 % confidence; fractions 0 and 1 are the exact least and greatest value. NULL and NaN
    values are left out, and a series without others has no row. :func:`ecdf` is the exact form.
    """
    if points < 2:
        raise ValueError("a curve has at least two points")
    kept = df.select(*by, F.col(f"`{value}`").cast("double").alias(value)).filter(F.col(value).isNotNull() & ~F.isnan(value))
    # all of the table is one series; an aggregate without groups would give a row for no rows
    keys = list(by) or ["_one"]
    sketched = kept.withColumns({} if by else {"_one": F.lit(1)}).groupBy(*keys).agg(
        F.kll_sketch_agg_double(value, F.lit(k)).alias("_sketch"), F.min(value).alias("_lo"), F.max(value).alias("_hi")
    )
    at = [i / (points - 1) for i in range(points)]
    inner = F.kll_sketch_get_quantile_double("_sketch", F.array(*map(F.lit, at)))
    rows = sketched.select(*by, "_lo", "_hi", F.posexplode(F.arrays_zip(F.array(*map(F.lit, at)).alias("p"), inner.alias("v"))))
    exact = F.when(F.col("pos") == 0, F.col("_lo")).when(F.col("pos") == points - 1, F.col("_hi")).otherwise(F.col("col.v"))
    return rows.select(*by, F.col("col.p").alias(name), exact.alias(value))


def rank_error(k: int = 800) -> float:
    """Normalised rank error of a sketch of size ``k`` for a single quantile, at 99 % confidence.

    The published fit for these sketches, 2.296 / k ^ 0.9723.
    """
    return 2.296 / k**0.9723


def quantiles(
    df: DataFrame,
    value: str,
    ps: dict[str, float],
    by: Sequence[str] = (),
    sizes: str | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of ``ps``."""
    runs = value_runs(df, value, by, range_rows)
    last = F.col("upto") - 1
    first = F.col("upto") - F.col("n")
    lo, hi = {}, {}
    aggs = []
    v = F.col(value)
    for name, p in ps.items():
        spot = (F.col("upto_total") - 1) * F.lit(float(p))
        below, above = F.floor(spot), F.ceil(spot)
        lo[name] = F.max(F.when((first <= below) & (below <= last), v))
        hi[name] = F.max(F.when((first <= above) & (above <= last), v))
        aggs += [
            lo[name].alias(f"_lo_{name}"),
            hi[name].alias(f"_hi_{name}"),
            F.max(spot - below).alias(f"_t_{name}"),
        ]
    aggs.append(F.max("upto_total").alias("_size"))
    got = runs.groupBy(*by).agg(*aggs)
    cols = [
        (
            F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_t_{n}")
        ).alias(n)
        for n in ps
    ]
    if sizes:
        cols.append(F.col("_size").alias(sizes))
    return got.select(*by, *cols)
