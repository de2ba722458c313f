"""Ridge from triangular factors: equal to the row-by-row procedure, and right where Gram sums are not."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ridge import ALPHAS, data, numpy_select  # noqa: F401

from cohortloom.operators import ridge, tsqr


def rows_of(spark, x, y, **more):
    n = len(y)
    rows = [(f"r{i:05d}", f"s{i % 13:02d}", float(y[i]), x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "row string, subject string, y double, features array<double>")


@pytest.mark.parametrize("buffer_bytes, fan_in, parts", [(256 << 20, 8, 5), (2_000, 2, 17)])
def test_same_models_as_row_by_row(data, buffer_bytes, fan_in, parts):  # noqa: F811
    pdf, df = data
    fit = tsqr.nested_qr(df.repartition(parts), "subject", ["row"], "features", "y", 5, ALPHAS, buffer_bytes=buffer_bytes, fan_in=fan_in)
    got = ridge.predict_oof(fit, "features", "y").toPandas().sort_values("row")
    assert len(got) == len(pdf) and got["row"].is_unique
    x, y = np.stack(got["features"]), got["y"].to_numpy()
    for fold in range(1, 6):
        test = (got["fold"] == fold).to_numpy()
        alpha, predict, _ = numpy_select(x[~test], y[~test], 5)
        assert set(got["alpha"][test]) == {alpha}
        assert np.allclose(got["prediction"][test], predict(x[test]))
    alpha, _, w = numpy_select(x, y, 5)
    assert fit.final.alpha == alpha and np.allclose(fit.final.standardized, w)


def test_inner_groups(data):  # noqa: F811
    _, df = data
    a = ridge.nested_cv(df, "subject", ["row"], "features", "y", 4, ALPHAS, inner_grouped=True)
    b = tsqr.nested_qr(df, "subject", ["row"], "features", "y", 4, ALPHAS, inner_grouped=True)
    assert sorted(a.folds) == sorted(b.folds)
    for one, other in [(a.final, b.final), *[(a.folds[o], b.folds[o]) for o in a.folds]]:
        assert one.alpha == other.alpha and np.allclose(one.coef, other.coef) and np.isclose(one.intercept, other.intercept)


def test_nearly_dependent_features(spark):
    """Two features that differ by one part in 10^8: their Gram matrix is singular in doubles."""
    rng = np.random.default_rng(7)
    n = 400
    a, gap = rng.normal(0, 1, n), rng.normal(0, 1, n) * 1e-8
    x = np.column_stack([a, a + gap, rng.normal(0, 1, n)])
    y = 3 * a + 2e8 * gap + x[:, 2]
    df = rows_of(spark, x, y).withColumn("cell", F.lit("a"))
    alpha = 1e-24

    def direct():
        mean, std = x.mean(0), x.std(0)
        z = np.vstack([(x - mean) / std, np.sqrt(alpha) * np.eye(3)])
        w, *_ = np.linalg.lstsq(z, np.concatenate([y - y.mean(), np.zeros(3)]), rcond=None)
        return (x - mean) / std @ w + y.mean()

    def residual(predicted):
        return float(np.abs(predicted - y).max())

    flat = tsqr.cell_factors(df.repartition(7), "features", "y", "cell", 3, buffer_bytes=3_000, fan_in=2).first()["factor"]
    factor = np.reshape(flat, (-1, 5))
    beta = tsqr.ridge_path_of(factor, tsqr.deviations(factor), [alpha])[0]
    by_factor = beta[0] + x @ beta[1:]
    shift = ridge.feature_means(df, "features", "y")
    gram = np.reshape(ridge.gram_sums(df, "features", "y", "cell", shift).first()["gram"], (5, 5))
    try:
        b = ridge.ridge_path(gram, ridge.Moments.of(gram).deviation(), [alpha])[0]
        by_gram = residual(b[0] + shift[-1] + (x - shift[:-1]) @ b[1:])
    except np.linalg.LinAlgError:
        by_gram = np.inf
    assert residual(direct()) < 1e-4 and residual(by_factor) < 1e-4
    assert np.allclose(by_factor, direct(), atol=1e-4)
    assert by_gram > 0.1


def test_many_features(spark):
    """More features than rows in any cell."""
    rng = np.random.default_rng(3)
    n, p = 300, 200
    x = rng.normal(0, 1, (n, p))
    y = x[:, :5].sum(axis=1) + rng.normal(0, 0.1, n)
    fit = tsqr.nested_qr(rows_of(spark, x, y), "subject", ["row"], "features", "y", 3, (1.0, 100.0))
    alphas = (1.0, 100.0)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + fit.final.alpha * np.eye(p), z.T @ (y - y.mean()))
    assert fit.final.alpha in alphas and np.allclose(fit.final.standardized, w)


def test_means_and_deviations_are_exact_far_from_zero(spark):
    x = np.column_stack([1e9 + np.arange(50.0), np.full(50, 7.0)])
    df = rows_of(spark, x, np.arange(50.0)).withColumn("cell", F.lit("a"))
    factor = np.reshape(tsqr.cell_factors(df, "features", "y", "cell", 2).first()["factor"], (-1, 4))
    n, mean, _ = tsqr.centred(factor)
    assert np.isclose(n, 50) and np.allclose(mean, [1e9 + 24.5, 7, 24.5], rtol=1e-15)
    assert np.allclose(tsqr.deviations(factor), [np.arange(50.0).std(), 1.0], rtol=1e-6)


@pytest.mark.parametrize("rows", [[([1.0, 2.0], 1.0), ([1.0], 2.0)], [([1.0, None], 1.0)], [([1.0, 2.0], None)]])
def test_ragged_and_missing_features_are_an_error(spark, rows):
    df = spark.createDataFrame([(*r, "c") for r in rows], "x array<double>, y double, cell string")
    with pytest.raises(Exception, match="features|missing"):
        tsqr.cell_factors(df, "x", "y", "cell", 2).collect()


def test_no_rows_and_one_group(spark):
    none = spark.createDataFrame([], "x array<double>, y double, cell string")
    assert tsqr.cell_factors(none, "x", "y", "cell", 2).count() == 0
    one = rows_of(spark, np.ones((3, 1)), np.ones(3)).withColumn("subject", F.lit("s"))
    with pytest.raises(ValueError, match="two groups"):
        tsqr.nested_qr(one, "subject", ["row"], "features", "y")
