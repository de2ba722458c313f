import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from cohortloom.operators.folds import group_kfold, lightest_first
from cohortloom.operators.ridge import (
    Moments,
    coefficients,
    feature_means,
    gram_sums,
    nested_cv,
    predict_oof,
    ridge_path,
)
from cohortloom.operators.scoring import score

ALPHAS = (0.01, 1.0, 30.0, 1000.0)
P = 3


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 240
    x = rng.normal(0, [1, 20, 0.1], (n, P)) + [5, 100, 0]
    y = x @ [2.0, 0.3, -4.0] + rng.normal(0, 4, n) + 60
    # one subject holds a third of the rows
    subject = np.where(np.arange(n) % 3 == 0, "s00", [f"s{i:02d}" for i in rng.integers(1, 25, n)])
    pdf = pd.DataFrame({"row": [f"r{i:04d}" for i in range(n)], "subject": subject, "y": y})
    pdf["features"] = x.tolist()
    schema = "row string, subject string, y double, features array<double>"
    rows = [tuple(r) for r in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, schema).repartition(5)


def brute_greedy(classes, k):
    loads, quotas = [0] * k, {}
    for size, count in sorted(classes, reverse=True):
        quota = [0] * k
        for _ in range(count):
            i = int(np.argmin(loads))
            loads[i] += size
            quota[i] += 1
        quotas[size] = quota
    return quotas


def test_fill_level_equals_the_step_by_step_greedy():
    rng = np.random.default_rng(5)
    for _ in range(200):
        k = int(rng.integers(1, 8))
        sizes = rng.choice(np.arange(1, 60), int(rng.integers(1, 12)), replace=False)
        classes = [(int(s), int(rng.integers(1, 40))) for s in sizes]
        assert lightest_first(classes, k) == brute_greedy(classes, k)


def test_grouped_folds_keep_groups_whole_and_balanced(data):
    pdf, df = data
    folded = group_kfold(df, "subject", 5).toPandas()
    assert len(folded) == len(pdf)
    assert (folded.groupby("subject")["fold"].nunique() == 1).all()
    loads = folded.groupby("fold").size()
    assert loads.max() - loads.min() <= pdf.groupby("subject").size().max()
    assert set(group_kfold(df.filter("subject in ('s01', 's02')"), "subject", 5).toPandas()["fold"]) == {1, 2}


def numpy_ridge(x, y, alpha, mean, std):
    z = (x - mean) / std
    zc, yc = z - z.mean(0), y - y.mean()
    w = np.linalg.solve(zc.T @ zc + alpha * np.eye(z.shape[1]), zc.T @ yc)
    return lambda q: ((q - mean) / std - z.mean(0)) @ w + y.mean(), w


def numpy_select(x, y, k, inner=None):
    """The reference procedure written out row by row."""
    mean, std = x.mean(0), x.std(0)
    pieces = np.array_split(np.arange(len(y)), k) if inner is None else inner
    scores = []
    for alpha in ALPHAS:
        r2 = []
        for held in pieces:
            train = np.setdiff1d(np.arange(len(y)), held)
            predict, _ = numpy_ridge(x[train], y[train], alpha, mean, std)
            sse = ((y[held] - predict(x[held])) ** 2).sum()
            r2.append(1 - sse / ((y[held] - y[held].mean()) ** 2).sum())
        scores.append(np.mean(r2))
    alpha = ALPHAS[int(np.argmax(scores))]
    predict, w = numpy_ridge(x, y, alpha, mean, std)
    return alpha, predict, w


def test_nested_search_equals_the_row_by_row_procedure(data):
    pdf, df = data
    fit = nested_cv(df, "subject", ["row"], "features", "y", 5, ALPHAS)
    got = predict_oof(fit, "features", "y").toPandas().sort_values("row")
    assert len(got) == len(pdf) and got["row"].is_unique
    assert (got.groupby("subject")["fold"].nunique() == 1).all()
    x, y = np.stack(got["features"]), got["y"].to_numpy()
    for fold in range(1, 6):
        test = (got["fold"] == fold).to_numpy()
        alpha, predict, _ = numpy_select(x[~test], y[~test], 5)
        assert set(got["alpha"][test]) == {alpha}
        assert np.allclose(got["prediction"][test], predict(x[test]))
    assert np.allclose(got["residual"], got["prediction"] - got["y"])
    assert np.allclose(got["absolute_error"], got["residual"].abs())
    alpha, _, w = numpy_select(x, y, 5)
    assert fit.final.alpha == alpha and np.allclose(fit.final.standardized, w)


def test_result_does_not_depend_on_partitioning(data):
    _, df = data
    want = None
    for n in (1, 17):
        fit = nested_cv(df.repartition(n), "subject", ["row"], "features", "y", 3, ALPHAS)
        rows = predict_oof(fit, "features", "y").orderBy("row").select("row", "fold", "prediction").toPandas()
        if want is not None:
            assert (rows["fold"] == want["fold"]).all() and np.allclose(rows["prediction"], want["prediction"])
        want = rows


def test_inner_folds_can_respect_groups(data):
    pdf, df = data
    fit = nested_cv(df, "subject", ["row"], "features", "y", 4, ALPHAS, inner_grouped=True)
    got = predict_oof(fit, "features", "y").toPandas().sort_values("row")
    x, y = np.stack(got["features"]), got["y"].to_numpy()
    for fold in range(1, 5):
        test = (got["fold"] == fold).to_numpy()
        train = got[~test].reset_index(drop=True)
        inner = group_kfold(df.join(fit.rows.select("row", "fold").withColumnRenamed("fold", "f"), "row").filter(f"f <> {fold}"), "subject", 4)
        places = train[["row"]].merge(inner.select("row", "fold").toPandas(), on="row")["fold"]
        pieces = [np.flatnonzero(places == i) for i in range(1, 5)]
        alpha, predict, _ = numpy_select(x[~test], y[~test], 4, pieces)
        assert set(got["alpha"][test]) == {alpha}
        assert np.allclose(got["prediction"][test], predict(x[test]))


def test_solve_equals_linear_regression(data, spark):
    pdf, df = data
    shift = feature_means(df, "features", "y")
    rows = df.withColumn("cell", F.lit("a"))
    gram = np.asarray(gram_sums(rows, "features", "y", "cell", shift).first()["gram"]).reshape(P + 2, P + 2)
    alpha, n = 10.0, len(pdf)
    beta = ridge_path(gram, np.ones(P), [alpha])[0]
    wide = df.select("y", *[F.get("features", F.lit(i)).alias(f"x{i}") for i in range(P)])
    wide = VectorAssembler(inputCols=[f"x{i}" for i in range(P)], outputCol="v").transform(wide)
    reg = alpha / n * float(np.std(pdf["y"]))
    model = LinearRegression(
        featuresCol="v", labelCol="y", solver="normal", standardization=False, regParam=reg, elasticNetParam=0.0
    ).fit(wide)
    assert np.allclose(model.coefficients.toArray(), beta[1:], rtol=1e-7)


def test_constant_feature_is_not_scaled(spark):
    rows = spark.createDataFrame([([1.0, 7.0], float(i), "a") for i in range(5)], "features array<double>, y double, cell string")
    gram = np.asarray(gram_sums(rows, "features", "y", "cell", [0, 0, 0]).first()["gram"]).reshape(4, 4)
    assert list(Moments.of(gram).deviation()) == [1.0, 1.0]


def test_coefficients_by_magnitude(data, spark):
    fit = nested_cv(data[1], "subject", ["row"], "features", "y", 3, ALPHAS)
    values = [abs(r[1]) for r in coefficients(spark, fit.final, ["a", "b", "c"]).collect()]
    assert values == sorted(values, reverse=True)


def test_one_group_is_an_error(data):
    with pytest.raises(ValueError, match="two groups"):
        nested_cv(data[1].filter("subject = 's00'"), "subject", ["row"], "features", "y")


def test_user_model_keeps_the_key(data):
    def make():
        import numpy as np

        weights = np.array([1.0, 2.0, 3.0])
        return lambda batch: batch @ weights

    pdf, df = data
    got = score(df, make, "features", P, 64).toPandas().set_index("row")["prediction"]
    want = np.stack(pdf["features"]) @ [1.0, 2.0, 3.0]
    assert np.allclose(got.loc[pdf["row"]], want)


@pytest.mark.parametrize("rows", [[([1.0, 2.0], 1.0), ([1.0], 2.0)], [([1.0, None], 1.0)], [([1.0, 2.0], None)]])
def test_ragged_and_missing_features_are_an_error(spark, rows):
    df = spark.createDataFrame([(*r, "c") for r in rows], "x array<double>, y double, cell string")
    with pytest.raises(Exception, match="features|missing"):
        gram_sums(df, "x", "y", "cell", [0.0, 0.0, 0.0]).collect()
