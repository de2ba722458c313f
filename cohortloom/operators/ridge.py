"""Ridge regression with nested, subject-grouped selection from distributed Gram sums.

One pass over the rows adds up ``[1, x, y]' [1, x, y]`` per cell.  A cell is the set of rows that
share their place in every outer and inner split, so any training or validation set is a sum of
cells and all models of the whole search follow from one small table of sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.config import RIDGE_ALPHAS, RIDGE_FOLDS
from cohortloom.functions.arrays import dot
from cohortloom.operators.folds import assign_groups, group_sizes
from cohortloom.operators.joins import attach_group
from cohortloom.operators.positions import fold_of, running_totals
from cohortloom.session import materialize



# --- scaling --------------------------------------------------------------------------------


def fit_scaler(long: DataFrame, feature: str, value: str) -> DataFrame:
    """Mean and population standard deviation per feature; a zero deviation becomes 1."""
    std = F.stddev_pop(value)
    return long.groupBy(feature).agg(
        F.avg(value).alias("mean"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias("std")
    )


def scale(long: DataFrame, scaler: DataFrame, feature: str, value: str, name: str = "z") -> DataFrame:
    """Standardized values of a long feature table."""
    z = (F.col(value) - F.col("mean")) / F.col("std")
    return attach_group(long, scaler, [feature], "inner").withColumn(name, z).drop("mean", "std")


# --- Gram sums ------------------------------------------------------------------------------


def design_rows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``[x, y]`` of a batch and the codes of its cells' names; ragged rows and missing values are an error."""
    n = batch.num_rows
    y = batch.column("y").to_numpy(zero_copy_only=False)
    listed = batch.column("features")
    ragged = n - (pc.sum(pc.fill_null(pc.equal(pc.list_value_length(listed), width), False)).as_py() or 0)
    if ragged:
        raise ValueError(f"{ragged} rows do not have {width} features")
    x = listed.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float)
    missing = int((np.isnan(x).any(axis=1) | np.isnan(y)).sum())
    if missing:
        raise ValueError(f"{missing} rows have a missing feature or target")
    return np.column_stack([x, y]), batch.column("cell").to_numpy(zero_copy_only=False).astype(str)


def _partial_grams(shift: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        sums = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            xy, cells = design_rows(batch, len(shift) - 1)
            z = np.column_stack([np.ones(len(xy)), xy - shift])
            names, codes = np.unique(cells, return_inverse=True)
            for i, cell in enumerate(names):
                part = z[codes == i]
                sums[cell] = sums.get(cell, 0) + part.T @ part
        if sums:
            yield pa.RecordBatch.from_pydict(
                {"cell": list(sums), "gram": [g.ravel().tolist() for g in sums.values()]},
                schema=pa.schema([("cell", pa.string()), ("gram", pa.list_(pa.float64()))]),
            )

    return run


def model_cells(df: DataFrame, features: str, y: str, cell: str) -> DataFrame:
    """The columns that the sums and factors are made of: ``features, y, cell``."""
    return df.select(
        F.col(features).alias("features"),
        F.col(y).cast("double").alias("y"),
        F.col(cell).cast("string").alias("cell"),
    )


def _add(pdf):
    first = pdf.iloc[:1].copy()
    first["gram"] = [np.sum(np.stack(pdf["gram"].to_numpy()), axis=0)]
    return first


def gram_sums(df: DataFrame, features: str, y: str, cell: str, shift: Sequence[float]) -> DataFrame:
    """Per cell the flattened ``[1, x - shift, y - shift]`` Gram matrix.

    Tasks emit one matrix per cell they meet.  The matrices are added in three steps, the first in as
    many shards as Spark has shuffle partitions, the second in the square root of that, so that no
    reducer receives very many of them.  Rows that are ragged or have a missing value are an error.
    """
    rows = model_cells(df, features, y, cell)
    schema = "cell string, gram array<double>"
    parts = rows.mapInArrow(_partial_grams(np.asarray(shift, dtype=float)), schema)
    shards = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sharded = "cell string, gram array<double>, shard int"
    parts = parts.withColumn("shard", F.spark_partition_id())
    for count in dict.fromkeys([shards, math.isqrt(shards)]):
        parts = parts.withColumn("shard", F.pmod("shard", F.lit(count)).cast("int"))
        parts = parts.groupBy("cell", "shard").applyInPandas(_add, sharded)
    return parts.drop("shard").groupBy("cell").applyInPandas(_add, schema)


def feature_means(df: DataFrame, features: str, y: str) -> list[float]:
    """Means of all features and of the target; subtracting them keeps the sums accurate."""
    first = df.select(F.size(features).alias("p")).first()
    if first is None:
        raise ValueError("no rows to fit a model on")
    cols = [F.avg(F.get(features, F.lit(i))).alias(f"m{i}") for i in range(first["p"])]
    return [float(v) for v in df.agg(*cols, F.avg(F.col(y).cast("double")).alias("y")).first()]


# --- solves on the sums (driver, size features x features) ---------------------------------------


@dataclass(frozen=True)
class Ridge:
    """A fitted model: prediction is ``intercept + coef . x``; ``standardized`` is per scaled unit."""

    alpha: float
    intercept: float
    coef: tuple[float, ...]
    standardized: tuple[float, ...]


@dataclass(frozen=True)
class Moments:
    n: float
    x: np.ndarray
    y: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    @staticmethod
    def of(gram: np.ndarray) -> "Moments":
        n = gram[0, 0]
        sx, sy = gram[0, 1:-1], gram[0, -1]
        return Moments(
            n,
            sx / n,
            sy / n,
            gram[1:-1, 1:-1] - np.outer(sx, sx) / n,
            gram[1:-1, -1] - sx * sy / n,
            gram[-1, -1] - sy * sy / n,
        )

    def deviation(self) -> np.ndarray:
        """Population standard deviation per feature; 1 where the feature is constant."""
        var = np.maximum(np.diag(self.xx) / self.n, 0.0)
        eps = np.finfo(float).eps
        flat = var <= self.n * eps * var + (self.n * self.x * eps) ** 2
        return np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, var)))


def ridge_path(gram: np.ndarray, std: np.ndarray, alphas: Sequence[float]) -> list[np.ndarray]:
    """For each penalty the coefficients ``[intercept, b]`` of the sums, in shifted units."""
    m = Moments.of(gram)
    xx = m.xx / np.outer(std, std)
    xy = m.xy / std
    out = []
    for alpha in alphas:
        b = np.linalg.solve(xx + alpha * np.eye(len(std)), xy) / std
        out.append(np.concatenate([[m.y - b @ m.x], b]))
    return out


def r_squared(gram: np.ndarray, beta: np.ndarray) -> float:
    """R2 of a model on the rows behind a Gram matrix."""
    v = np.concatenate([-beta, [1.0]])
    sse = max(float(v @ gram @ v), 0.0)
    sst = float(Moments.of(gram).yy)
    if sst <= 0.0:
        return 1.0 if sse == 0.0 else 0.0
    return 1.0 - sse / sst


def select_alpha(folds: Sequence[np.ndarray], total: np.ndarray, alphas: Sequence[float]) -> int:
    """Index of the penalty with the best mean validation R2; the first one on a tie.

    Scaling comes from the whole training set, as in a pipeline whose scaler precedes the search.
    """
    std = Moments.of(total).deviation()
    scores = np.zeros(len(alphas))
    for held in folds:
        path = ridge_path(total - held, std, alphas)
        scores += [r_squared(held, beta) for beta in path]
    return int(np.argmax(scores / len(folds)))


def fit_selected(
    folds: Sequence[np.ndarray], shift: Sequence[float], alphas: Sequence[float]
) -> Ridge:
    """Select the penalty over the given validation folds and refit on their union."""
    total = np.sum(folds, axis=0)
    alpha = alphas[select_alpha(folds, total, alphas)]
    std = Moments.of(total).deviation()
    beta = ridge_path(total, std, [alpha])[0]
    shift = np.asarray(shift, dtype=float)
    b = beta[1:]
    intercept = beta[0] + shift[-1] - b @ shift[:-1]
    return Ridge(float(alpha), float(intercept), tuple(map(float, b)), tuple(map(float, b * std)))


# --- nested selection --------------------------------------------------------------------------


def with_places(
    df: DataFrame, group: str, order: Sequence[str], k: int, inner_grouped: bool = False
) -> DataFrame:
    """Append ``fold`` and ``places``, the row's validation fold in every split (0: left out).

    Split 0 uses all rows, split ``o`` the rows outside outer fold ``o``.

    Outer folds hold whole groups.  The inner folds of outer fold ``o`` are contiguous pieces, in
    ``order``, of the rows outside ``o``; a row's place there is its position minus the rows of
    ``o`` before it.  All k + 1 inner splits therefore come from one pass of running counts.
    """
    sizes = group_sizes(df, group)
    outer = materialize(assign_groups(sizes, group, "_n_rows", k), "groups")
    if inner_grouped:
        table = outer.drop("_n_rows").withColumn("_i0", F.col("fold"))
        for o in range(1, k + 1):
            train = outer.filter(F.col("fold") != o).drop("fold")
            inner = assign_groups(train, group, "_n_rows", k, f"_i{o}").drop("_n_rows")
            table = table.join(inner, group, "left")
        placed = attach_group(df, table, [group], "inner")
        inner = [F.coalesce(F.col(f"_i{o}"), F.lit(0)) for o in range(0, k + 1)]
    else:
        loads = dict(outer.groupBy("fold").agg(F.sum("_n_rows")).collect())  # one row per fold
        everyone = sum(loads.values())
        placed = attach_group(df, outer.drop("_n_rows"), [group], "inner")
        weights = {"_c0": F.lit(1).cast("long")}
        for o in range(1, k + 1):
            weights[f"_c{o}"] = (F.col("fold") == o).cast("long")
        placed = running_totals(placed, order, weights, totals=False)
        inner = [fold_of(F.col("_c0"), F.lit(everyone), k)]
        for o in range(1, k + 1):
            place = F.col("_c0") - F.col(f"_c{o}")
            piece = fold_of(place, F.lit(everyone - loads.get(o, 0)), k)
            inner.append(F.when(F.col("fold") == o, F.lit(0)).otherwise(piece))
    scratch = [c for c in placed.columns if c.startswith(("_c", "_i"))]
    return placed.withColumn("places", F.array(*[c.cast("int") for c in inner])).drop(*scratch)


@dataclass(frozen=True)
class NestedFit:
    """Result of the nested search: one model per outer fold and the refit on everything."""

    rows: DataFrame
    folds: dict[int, Ridge]
    final: Ridge
    #: Mean of the target over all rows.
    mean: float = math.nan


def nested_cv(
    df: DataFrame,
    group: str,
    order: Sequence[str],
    features: str,
    y: str,
    k: int = RIDGE_FOLDS,
    alphas: Sequence[float] = RIDGE_ALPHAS,
    inner_grouped: bool = False,
) -> NestedFit:
    """Outer grouped folds; per outer training set an inner search for the penalty.

    ``order`` must be a total order of the rows.
    """
    k = min(k, df.select(group).distinct().limit(k).count())
    if k < 2:
        raise ValueError("at least two groups are needed")
    rows = materialize(with_places(df, group, order, k, inner_grouped), "folds")
    shift = feature_means(rows, features, y)
    if inner_grouped:
        # any combination of places may occur: one membership per row and split
        placed = rows.select(features, y, F.posexplode("places").alias("split", "place"))
        placed = placed.filter("place > 0").withColumn("cell", F.concat_ws("-", "split", "place"))
    else:
        # contiguous pieces: at most k * (k * k) combinations, and each row belongs to one
        placed = rows.withColumn("cell", F.array_join("places", "-"))
    q = len(shift) + 1
    cells = {
        tuple(map(int, r["cell"].split("-"))): np.asarray(r["gram"]).reshape(q, q)
        for r in gram_sums(placed, features, y, "cell", shift).collect()
    }

    def held_out(split: int, piece: int) -> list[np.ndarray]:
        if inner_grouped:
            return [cells[split, piece]] if (split, piece) in cells else []
        return [g for places, g in cells.items() if places[split] == piece]

    def fit(split: int) -> Ridge:
        pieces = [held_out(split, i) for i in range(1, k + 1)]
        return fit_selected([np.sum(p, axis=0) for p in pieces if p], shift, alphas)

    return NestedFit(rows.drop("places"), {o: fit(o) for o in range(1, k + 1)}, fit(0), shift[-1])


def model_table(spark, models: dict[int, Ridge]) -> DataFrame:
    """One row per fold with its model."""
    schema = "fold int, alpha double, intercept double, coef array<double>"
    rows = [(o, m.alpha, m.intercept, list(m.coef)) for o, m in sorted(models.items())]
    return spark.createDataFrame(rows, schema)


def predict_oof(fit: NestedFit, features: str, y: str) -> DataFrame:
    """Out-of-fold predictions with residual, absolute error, fold and penalty."""
    models = F.broadcast(model_table(fit.rows.sparkSession, fit.folds))  # one row per fold
    scored = fit.rows.join(models, "fold")
    prediction = F.col("intercept") + dot(F.col("coef"), F.col(features))
    scored = scored.withColumn("prediction", prediction)
    residual = F.col("prediction") - F.col(y)
    return scored.withColumns({"residual": residual, "absolute_error": F.abs(residual)}).drop(
        "intercept", "coef"
    )


def coefficients(spark, model: Ridge, names: Sequence[str]) -> DataFrame:
    """Standardized coefficients of a model, largest magnitude first."""
    schema = T.StructType(
        [
            T.StructField("feature", T.StringType()),
            T.StructField("standardized_coefficient", T.DoubleType()),
        ]
    )
    table = spark.createDataFrame(list(zip(names, model.standardized)), schema)
    return table.orderBy(F.abs("standardized_coefficient").desc(), "feature")
