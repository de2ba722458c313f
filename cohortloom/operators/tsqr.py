"""Ridge regression from triangular factors: for many features, and for features that nearly depend on each other.

A Gram matrix squares the condition of its rows. Here the rows ``[1, x, y]`` of a cell are reduced to the factor R
of their QR decomposition, whose condition is theirs: every task reduces the rows it meets, block by block, and
factors of the same cell are stacked and reduced again along a tree, ``FAN_IN`` at a time. The factor of a union of
cells is the factor of their stacked factors, so all models of the nested search follow from one factor per split and
piece. They are fitted in tasks of their own, one for each split and held-out piece; scores and finished models are
all that reaches the driver.

The first column of ones makes centring exact: R below its first row is the factor of the centred columns.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.config import RIDGE_ALPHAS, RIDGE_FOLDS
from cohortloom.operators.ridge import NestedFit, Ridge, design_rows, model_cells, with_places
from cohortloom.session import materialize

#: Factors that meet in one task.
FAN_IN = 8
#: Bytes of rows and factors that a task holds back.
BUFFER_BYTES = 256 << 20

FACTOR = pa.schema([("cell", pa.string()), ("factor", pa.list_(pa.float64()))])


def reduced(stack: np.ndarray) -> np.ndarray:
    """The factor R of stacked rows; fewer rows than columns are their own factor."""
    return np.linalg.qr(stack, mode="r") if len(stack) > stack.shape[1] else stack


def _task_factors(width: int, buffer_bytes: int):
    q = width + 2

    def out(held: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
        factors = [reduced(np.vstack(parts)).ravel() for parts in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(factors, FACTOR.field(1).type)], schema=FACTOR)

    def run(batches):
        held, rows, total = {}, {}, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            xy, cells = design_rows(batch, width)
            z = np.column_stack([np.ones(len(xy)), xy])
            names, codes = np.unique(cells, return_inverse=True)
            for i, cell in enumerate(names):
                held.setdefault(cell, []).append(z[codes == i])
                rows[cell] = rows.get(cell, 0) + len(held[cell][-1])
                total += held[cell][-1].nbytes
                if rows[cell] >= 4 * q:
                    before = sum(part.nbytes for part in held[cell])
                    held[cell] = [reduced(np.vstack(held[cell]))]
                    rows[cell] = len(held[cell][0])
                    total += held[cell][0].nbytes - before
            if total > buffer_bytes:
                yield out(held)
                held, rows, total = {}, {}, 0
        if held:
            yield out(held)

    return run


def _stack(table: pa.Table, q: int) -> np.ndarray:
    """All rows of the factors of a table."""
    values = table.column("factor").combine_chunks().flatten()
    return values.to_numpy(zero_copy_only=False).reshape(-1, q)


def tree_reduced(parts: DataFrame, keys: Sequence[str], q: int, fan_in: int = FAN_IN) -> DataFrame:
    """One factor per key from any number of factors: ``fan_in`` neighbouring ones become one in each round."""
    keys = list(keys)
    types = dict(parts.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "_node long, factor array<double>"])

    def join(table: pa.Table) -> pa.Table:
        factor = reduced(_stack(table, q)).ravel()
        row = {c: table.column(c).slice(0, 1).combine_chunks() for c in [*keys, "_node"]}
        return pa.table({**row, "factor": pa.array([factor], pa.list_(pa.float64()))})

    # stored: a factor keeps the number that it was written with
    level = materialize(parts.select(*keys, F.monotonically_increasing_id().alias("_id"), "factor"), "factors")
    # numbers of the factors of a key: at most one per task and flush, without the factors themselves
    numbered = level.select(*keys, "_id").withColumn("_node", F.row_number().over(Window.partitionBy(*keys).orderBy("_id")) - 1)
    most = numbered.agg(F.max("_node")).first()[0]
    if most is None:
        return parts.select(*keys, "factor")
    level = level.join(numbered.withColumn("_node", F.col("_node").cast("long")), [*keys, "_id"]).drop("_id")
    most += 1
    while True:
        level = level.withColumn("_node", F.expr(f"_node div {int(fan_in)}"))
        level = level.groupBy(*keys, "_node").applyInArrow(join, schema)
        most = -(-most // fan_in)
        if most <= 1:
            return level.drop("_node")


def cell_factors(df: DataFrame, features: str, y: str, cell: str, width: int, buffer_bytes: int = BUFFER_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """``cell, factor``: the factor R of ``[1, x, y]`` over the rows of each cell, row by row in one array.

    A task sends a factor of at most ``width + 2`` rows for each cell it meets, more often only when it holds
    back ``buffer_bytes``. Ragged rows and missing values are an error.
    """
    parts = model_cells(df, features, y, cell).mapInArrow(_task_factors(width, buffer_bytes), "cell string, factor array<double>")
    return tree_reduced(parts, ["cell"], width + 2, fan_in)


# --- solves on factors -----------------------------------------------------------------------------


def centred(factor: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Row count, means of ``[x, y]``, and the factor of the centred columns."""
    square = reduced(factor)
    if len(square) < square.shape[1]:
        square = np.linalg.qr(square, mode="r")
    n = float(square[0, 0] ** 2)
    return n, square[0, 1:] / square[0, 0], square[1:, 1:]


def deviations(factor: np.ndarray) -> np.ndarray:
    """Population standard deviation of each feature; 1 where it is constant."""
    n, mean, below = centred(factor)
    spread = np.sqrt((below[:, :-1] ** 2).sum(axis=0) / n)
    eps = np.finfo(float).eps
    flat = spread**2 <= n * eps * spread**2 + (n * mean[:-1] * eps) ** 2
    return np.where(flat, 1.0, spread)


def ridge_path_of(factor: np.ndarray, std: np.ndarray, alphas: Sequence[float]) -> list[np.ndarray]:
    """For each penalty the coefficients ``[intercept, b]``, all from one singular value decomposition."""
    _, mean, below = centred(factor)
    u, s, vt = np.linalg.svd(below[:, :-1] / std, full_matrices=False)
    target = u.T @ below[:, -1]
    out = []
    for alpha in alphas:
        b = vt.T @ (s / (s * s + alpha) * target) / std
        out.append(np.concatenate([[mean[-1] - b @ mean[:-1]], b]))
    return out


def r_squared_of(factor: np.ndarray, beta: np.ndarray) -> float:
    """R2 of a model on the rows behind a factor."""
    sse = float(((factor @ np.concatenate([-beta, [1.0]])) ** 2).sum())
    sst = float((centred(factor)[2][:, -1] ** 2).sum())
    if sst <= 0.0:
        return 1.0 if sse == 0.0 else 0.0
    return 1.0 - sse / sst


def _scores(alphas: Sequence[float], q: int):
    def run(table: pa.Table) -> pa.Table:
        piece = table.column("piece").to_numpy()
        held = int(table.column("held")[0].as_py())
        parts = [_stack(table.slice(i, 1), q) for i in range(len(piece))]
        std = deviations(np.vstack(parts))
        train = [part for part, i in zip(parts, piece) if i != held]
        valid = np.vstack([part for part, i in zip(parts, piece) if i == held])
        path = ridge_path_of(np.vstack(train), std, alphas)
        split = table.column("split")[0].as_py()
        return pa.table({
            "split": pa.array([split] * len(alphas), pa.int32()),
            "place": pa.array(range(len(alphas)), pa.int32()),
            "score": pa.array([r_squared_of(valid, beta) for beta in path], pa.float64()),
        })

    return run


def _models(chosen: dict[int, float], q: int):
    def run(table: pa.Table) -> pa.Table:
        split = int(table.column("split")[0].as_py())
        factor = _stack(table, q)
        std = deviations(factor)
        beta = ridge_path_of(factor, std, [chosen[split]])[0]
        return pa.table({
            "split": pa.array([split], pa.int32()),
            "intercept": pa.array([float(beta[0])], pa.float64()),
            "coef": pa.array([beta[1:]], pa.list_(pa.float64())),
            "standardized": pa.array([beta[1:] * std], pa.list_(pa.float64())),
        })

    return run


def fit_pieces(pieces: DataFrame, q: int, alphas: Sequence[float]) -> dict[int, Ridge]:
    """Per split the selected and refitted model, from ``split, piece, factor`` with one row for each piece.

    The penalty with the best mean validation R2 wins, the first one on a tie. The driver sees a score for each
    split, piece and penalty, and one model for each split.
    """
    pieces = materialize(pieces, "pieces")
    held = pieces.select("split", F.col("piece").alias("held"))
    scores = pieces.join(held, "split").groupBy("split", "held").applyInArrow(_scores(alphas, q), "split int, place int, score double")
    means = scores.groupBy("split", "place").agg(F.avg("score").alias("score")).collect()
    best = {}
    for r in sorted(means, key=lambda r: (r["split"], -r["score"], r["place"])):
        best.setdefault(r["split"], float(alphas[r["place"]]))
    schema = "split int, intercept double, coef array<double>, standardized array<double>"
    found = pieces.groupBy("split").applyInArrow(_models(best, q), schema).collect()
    return {r["split"]: Ridge(best[r["split"]], r["intercept"], tuple(r["coef"]), tuple(r["standardized"])) for r in found}


def nested_qr(
    df: DataFrame,
    group: str,
    order: Sequence[str],
    features: str,
    y: str,
    k: int = RIDGE_FOLDS,
    alphas: Sequence[float] = RIDGE_ALPHAS,
    inner_grouped: bool = False,
    buffer_bytes: int = BUFFER_BYTES,
    fan_in: int = FAN_IN,
) -> NestedFit:
    """The search of :func:`cohortloom.operators.ridge.nested_cv`, on factors instead of Gram sums.

    ``order`` must be a total order of the rows.
    """
    k = min(k, df.select(group).distinct().limit(k).count())
    if k < 2:
        raise ValueError("at least two groups are needed")
    rows = materialize(with_places(df, group, order, k, inner_grouped), "folds")
    width = rows.select(F.size(features)).first()[0]
    q = width + 2
    member = [F.posexplode("places").alias("split", "piece")]
    if inner_grouped:
        # any combination of places may occur: one membership per row and split
        placed = rows.select(features, y, *member).filter("piece > 0")
        factors = cell_factors(placed.withColumn("cell", F.concat_ws("-", "split", "piece")), features, y, "cell", width, buffer_bytes, fan_in)
        spot = F.split("cell", "-")
        pieces = factors.select(spot[0].cast("int").alias("split"), spot[1].cast("int").alias("piece"), "factor")
    else:
        # contiguous pieces: each row belongs to one of at most k * k * k cells, and a cell to one piece of each split
        placed = rows.withColumn("cell", F.array_join("places", "-"))
        factors = cell_factors(placed, features, y, "cell", width, buffer_bytes, fan_in)
        cells = factors.select(F.split("cell", "-").cast("array<int>").alias("places"), "factor")
        members = cells.select("factor", *member).filter("piece > 0")
        pieces = tree_reduced(members, ["split", "piece"], q, fan_in)
    models = fit_pieces(pieces, q, alphas)
    return NestedFit(rows.drop("places"), {o: m for o, m in models.items() if o > 0}, models[0], rows.agg(F.avg(F.col(y).cast("double"))).first()[0])
