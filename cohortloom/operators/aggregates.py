"""Counts, profiles, histograms, box statistics and regression metrics.

Every aggregate combines partial results before its shuffle.  Quantiles go through
:mod:`cohortloom.operators.selection`, which counts values by their bits and moves none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.config import LARGE_AGE
from cohortloom.functions.missing import nan_to_null
from cohortloom.functions.scalars import clip_upper
from cohortloom.operators.joins import attach_group
from cohortloom.operators.selection import select_quantiles
from cohortloom.session import materialize


def value_counts(df: DataFrame, col: str, k: int | None = None, name: str = "count") -> DataFrame:
    """Rows per value, most frequent first (ties by value); NULL is not counted."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
    if k is None:
        return counts
    return counts.orderBy(F.desc(name), col).limit(k)


def duplicate_summary(df: DataFrame, col: str) -> DataFrame:
    """One row: how many values occur more than once, and how many rows they cover."""
    groups = value_counts(df, col, name="n").filter("n > 1")
    return groups.agg(
        F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")
    )


def conflict_range(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Spread of a value per key; NULL keys form a group of their own."""
    spread = F.max(value) - F.min(value)
    return df.groupBy(*keys).agg(spread.alias("range"))


def range_alerts(df: DataFrame, by: str, value: str, limit: float = LARGE_AGE) -> DataFrame:
    """Groups whose largest value exceeds a limit."""
    top = df.groupBy(by).agg(F.max(nan_to_null(F.col(value))).alias("largest"))
    return top.filter(F.col("largest") > limit)


def distinct_counts(df: DataFrame, cols: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Distinct non-null values, per group or overall."""
    return df.groupBy(*by).agg(*[F.count_distinct(c).alias(n) for n, c in cols.items()])


def distinct_keys(df: DataFrame, cols: Sequence[str], name: str = "n") -> DataFrame:
    """Distinct composite keys; rows with a NULL part are left out."""
    return df.agg(F.count_distinct(*cols).alias(name))


def median_by(df: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return select_quantiles(df, value, {name: 0.5}, by)


def quantile_profile(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """p01, p05, median, p95 and the maximum."""
    return select_quantiles(df, value, {"p01": 0.01, "p05": 0.05, "median": 0.5, "p95": 0.95, "max": 1.0}, by)


def overview(df: DataFrame, by: str, path: str, subject: str, label: str) -> DataFrame:
    """Per dataset: images, distinct subjects, labelled fraction, images per subject.

    Subjects are grouped first, so the second step counts rows instead of distinct values and no
    row is copied for it.
    """
    labelled = F.col(label).isNotNull()
    persons = df.filter(F.col(by).isNotNull()).groupBy(by, subject).agg(
        F.count(path).alias("_images"),
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(labelled).alias("_labelled"),
    )
    per = persons.groupBy(by).agg(
        F.sum("_images").alias("n_images"),
        F.count(subject).alias("n_subs"),
        (F.sum("_labelled") / F.sum("_rows")).alias("frac_labeled"),
    )
    return per.withColumn("im_per_sub", F.try_divide(F.col("n_images"), F.col("n_subs")))


def non_null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count(c).alias(f"n_{c}") for c in cols])


def qc_summary(df: DataFrame, key: Sequence[str], score: str) -> DataFrame:
    """Lowest and mean score per scan."""
    c = nan_to_null(F.col(score))
    return df.groupBy(*key).agg(F.min(c).alias("qc_min"), F.avg(c).alias("qc_mean"))


def score_means(
    long: DataFrame, by: Sequence[str], value: str, name: str = "mean", rows: str | None = None
) -> DataFrame:
    """Mean of each score of a long score table; ``rows`` names a count of its rows."""
    aggs = [F.avg(nan_to_null(F.col(value))).alias(name)]
    if rows:
        aggs.append(F.count(F.lit(1)).alias(rows))
    return long.groupBy(*by).agg(*aggs)


def mask_rates(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """Per mask: how many rows it covers and their share; NULL counts as not covered."""
    aggs = []
    for name, mask in masks.items():
        hit = F.coalesce(mask, F.lit(False))
        aggs.append(F.count_if(hit).alias(f"n_{name}"))
        aggs.append(F.avg(hit.cast("double")).alias(f"rate_{name}"))
    return df.agg(*aggs)


def cohort_counts(
    df: DataFrame, dataset: str, subject: str, suffix: str, suffixes: Sequence[str]
) -> DataFrame:
    """One row: datasets, subjects, images and images per suffix.

    Counting per subject first reduces the rows before the distinct count of datasets.
    """
    persons = df.groupBy(dataset, subject).agg(
        F.count(F.lit(1)).alias("_images"),
        *[F.count_if(F.col(suffix) == s).alias(f"_n_{s}") for s in suffixes],
    )
    known = F.col(dataset).isNotNull() & F.col(subject).isNotNull()
    return persons.agg(
        F.count_distinct(dataset).alias("n_datasets"),
        F.count_if(known).alias("n_subjects"),
        F.coalesce(F.sum("_images"), F.lit(0)).alias("n_images"),
        *[F.coalesce(F.sum(f"_n_{s}"), F.lit(0)).alias(f"n_{s}") for s in suffixes],
    )


def histogram(
    df: DataFrame,
    value: str,
    bins: int,
    by: Sequence[str] = (),
    clip: float | None = None,
) -> DataFrame:
    """Equal bins over the data range of each group, empty bins included, last bin closed.

    Columns: ``by``, ``bin`` (1..bins), ``low``, ``high``, ``count``.
    """
    c = nan_to_null(F.col(value).cast("double"))
    if clip is not None:
        c = clip_upper(c, clip)
    kept = df.select(*by, c.alias("_v")).filter(F.col("_v").isNotNull())
    if not by:
        kept = kept.withColumn("_one", F.lit(1))
    keys = list(by) or ["_one"]
    spans = kept.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    if by:
        ranged = attach_group(kept.filter(_not_null(keys)), spans, keys, "inner")
    else:
        ranged = kept.withColumns(
            {"_lo": spans.select("_lo").scalar(), "_hi": spans.select("_hi").scalar()}
        )
    counts = ranged.groupBy(*keys, bin_of(F.col("_v"), F.col("_lo"), F.col("_hi"), bins).alias("bin"))
    counts = counts.agg(F.count(F.lit(1)).alias("count"))
    lo, hi = _span(F.col("_lo"), F.col("_hi"))
    step = (hi - lo) / F.lit(float(bins))
    grid = spans.filter(_not_null(keys)).withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    grid = grid.select(
        *keys,
        "bin",
        (lo + step * (F.col("bin") - 1)).alias("low"),
        (lo + step * F.col("bin")).alias("high"),
    )
    return grid.join(counts, [*keys, "bin"], "left").select(
        *by, "bin", "low", "high", F.coalesce("count", F.lit(0)).alias("count")
    )


def _not_null(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def _span(lo: Column, hi: Column) -> tuple[Column, Column]:
    """A single-valued range is widened by half a unit on both sides."""
    flat = lo == hi
    return F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, hi + 0.5).otherwise(hi)


def bin_of(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin number of a value; the last bin includes its right edge."""
    a, b = _span(lo, hi)
    return F.least(F.width_bucket(value, a, b, F.lit(bins)), F.lit(bins)).cast("int")


def box_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles, whisker ends within 1.5 IQR, and outlier count per group."""
    kept = df.filter(F.col(by).isNotNull() & F.col(value).isNotNull())
    marks = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    quart = materialize(select_quantiles(kept, value, marks, [by], "n_values"), "quartiles")
    iqr = F.col("q3") - F.col("q1")
    fences = quart.withColumns({"_low": F.col("q1") - 1.5 * iqr, "_high": F.col("q3") + 1.5 * iqr})
    # a row of fences for each group meets the values where they lie; nothing but sums by group is shuffled
    placed = attach_group(kept.select(by, value), fences.select(by, "_low", "_high"), [by], "inner")
    inside = F.col(value).between(F.col("_low"), F.col("_high"))
    ends = placed.groupBy(by).agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )
    return quart.join(ends, by)


def with_log_count(df: DataFrame, by: str, subject: str, name: str = "log_count") -> DataFrame:
    """log10 of the group's distinct subjects on every row."""
    sizes = df.groupBy(by, subject).agg(F.lit(1).alias("_one")).groupBy(by)
    sizes = sizes.agg(F.log10(F.count(subject)).alias(name))
    return attach_group(df, sizes, [by])


def eligible_groups(df: DataFrame, by: str, subject: str, minimum: int) -> DataFrame:
    """Groups with at least ``minimum`` distinct subjects."""
    pairs = df.filter(F.col(subject).isNotNull()).select(by, subject).distinct()
    return pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n_subs")).filter(F.col("n_subs") >= minimum)


def metric_columns(y: Column, yhat: Column) -> dict[str, Column]:
    """MAE, RMSE, R2, Pearson r, bias and n; R2 and r are NULL when a variance is zero."""
    e = yhat - y
    n = F.count(e)
    sse = F.sum(e * e)
    return {
        "mae": F.avg(F.abs(e)),
        "rmse": F.sqrt(F.avg(e * e)),
        "r2": 1 - F.try_divide(sse, F.var_pop(F.when(e.isNotNull(), y)) * n),
        "pearson_r": F.try_divide(
            F.covar_pop(y, yhat),
            F.stddev_pop(F.when(e.isNotNull(), y)) * F.stddev_pop(F.when(e.isNotNull(), yhat)),
        ),
        "bias": F.avg(e),
        "n": n,
    }


def regression_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """Error metrics of predictions, overall or per group."""
    cols = metric_columns(F.col(y).cast("double"), F.col(yhat).cast("double"))
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in cols.items()])


MOMENTS = ("n", "n_y", "y", "p", "yy", "pp", "yp", "e", "e_abs", "e_sq", "y_min", "y_max", "c_abs", "c_sq")


def error_moments(df: DataFrame, y: str, yhat: str, by: Sequence[str], centre: float | None = None) -> DataFrame:
    """Moments of targets and predictions per group, from which the metrics of any union of groups follow.

    ``n`` pairs, means ``y`` and ``p`` of both, sums of squares and products about the means, sums of the
    errors, their sizes and squares; ``n_y``, least and greatest of all targets; with ``centre`` also sums of the
    sizes and squares of the targets' distance from it. Rows without target or prediction are no pairs.
    """
    t, p = F.col(y).cast("double"), F.col(yhat).cast("double")
    e = p - t
    both = e.isNotNull()
    t_, p_ = F.when(both, t), F.when(both, p)
    c = t - F.lit(centre).cast("double")
    return df.groupBy(*by).agg(
        F.count(e).alias("n"),
        F.count(t).alias("n_y"),
        F.avg(t_).alias("y"),
        F.avg(p_).alias("p"),
        (F.var_pop(t_) * F.count(e)).alias("yy"),
        (F.var_pop(p_) * F.count(e)).alias("pp"),
        (F.covar_pop(t_, p_) * F.count(e)).alias("yp"),
        F.sum(e).alias("e"),
        F.sum(F.abs(e)).alias("e_abs"),
        F.sum(e * e).alias("e_sq"),
        F.min(t).alias("y_min"),
        F.max(t).alias("y_max"),
        F.sum(F.abs(c)).alias("c_abs"),
        F.sum(c * c).alias("c_sq"),
    )


def merged_moments(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Moments of coarser groups. Means are merged first, so that nothing is lost to large means."""
    keys = list(by) or ["_all"]
    rows = moments if by else moments.withColumn("_all", F.lit(0))
    own = F.struct("n", "y", "p", "yy", "pp", "yp")
    sums = ["n", "n_y", "e", "e_abs", "e_sq", "c_abs", "c_sq"]
    weight = F.sum("n")
    merged = rows.groupBy(*keys).agg(
        *[F.sum(c).alias(f"_{c}") for c in sums],
        (F.sum(F.col("n") * F.col("y")) / F.nullif(weight, F.lit(0))).alias("_y"),
        (F.sum(F.col("n") * F.col("p")) / F.nullif(weight, F.lit(0))).alias("_p"),
        F.min("y_min").alias("_y_min"),
        F.max("y_max").alias("_y_max"),
        F.collect_list(F.when(F.col("n") > 0, own)).alias("_parts"),  # a row for each of the finer groups
    )

    def about(square: str, a: str, b: str) -> Column:
        parts = F.transform("_parts", lambda x: x[square] + x["n"] * (x[a] - F.col(f"_{a}")) * (x[b] - F.col(f"_{b}")))
        return F.when(F.size("_parts") > 0, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)).alias(square)

    squares = {"yy": about("yy", "y", "y"), "pp": about("pp", "p", "p"), "yp": about("yp", "y", "p")}
    return merged.select(*by, *[squares.get(m, F.col(f"_{m}").alias(m)) for m in MOMENTS])


def metrics_of(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The columns of :func:`regression_metrics` from moments."""
    n = F.nullif("n", F.lit(0))
    return moments.select(
        *by,
        (F.col("e_abs") / n).alias("mae"),
        F.sqrt(F.col("e_sq") / n).alias("rmse"),
        (1 - F.try_divide(F.col("e_sq"), F.col("yy"))).alias("r2"),
        F.try_divide(F.col("yp"), F.sqrt(F.col("yy")) * F.sqrt(F.col("pp"))).alias("pearson_r"),
        (F.col("e") / n).alias("bias"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def baseline_metrics(df: DataFrame, y: str) -> DataFrame:
    """Metrics of predicting the mean for every row."""
    mean = df.agg(F.avg(F.col(y).cast("double")).alias("m")).scalar()
    return regression_metrics(df.withColumn("_mean", mean), y, "_mean")


def fold_metrics(df: DataFrame, y: str, yhat: str, fold: str, alpha: str) -> DataFrame:
    """Per fold: the selected penalty and the mean absolute error."""
    error = F.abs(F.col(yhat) - F.col(y))
    return df.groupBy(fold).agg(F.max(alpha).alias("alpha"), F.avg(error).alias("mae"))


def summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Row count, and minimum, maximum and mean of each column."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean")]
    return df.agg(*aggs)
