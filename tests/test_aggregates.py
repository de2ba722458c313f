import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import aggregates as A
from cohortloom.operators.ordering import TooFewRowsError, take_exact, top_abs, top_k


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 400), "y": rng.normal(50, 9, 400).round(2)})
    pdf["p"] = pdf["y"] + rng.normal(1, 3, 400)
    return pdf, spark.createDataFrame(pdf)


def test_metrics_match_numpy(numbers):
    pdf, df = numbers
    for (keys, group) in [(None, pdf), *pdf.groupby("g")]:
        by = [] if keys is None else ["g"]
        rows = A.regression_metrics(df, "y", "p", by)
        r = rows.first() if keys is None else rows.filter(F.col("g") == keys).first()
        e = group["p"] - group["y"]
        assert np.isclose(r.mae, e.abs().mean()) and np.isclose(r.rmse, np.sqrt((e**2).mean()))
        assert np.isclose(r.r2, 1 - (e**2).sum() / ((group["y"] - group["y"].mean()) ** 2).sum())
        assert np.isclose(r.pearson_r, np.corrcoef(group["y"], group["p"])[0, 1])
        assert np.isclose(r.bias, e.mean()) and r.n == len(group)


def test_constant_target_gives_null_not_an_error(spark):
    r = A.regression_metrics(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "y double, p double"), "y", "p").first()
    assert r.r2 is None and r.pearson_r is None and r.mae == 1.5


def test_mean_baseline_explains_nothing(numbers):
    r = A.baseline_metrics(numbers[1], "y").first()
    assert abs(r.r2) < 1e-9 and r.pearson_r is None


@pytest.mark.parametrize("clip", [None, 55.0])
def test_histogram_matches_numpy(numbers, clip):
    pdf, df = numbers
    values = pdf["y"] if clip is None else pdf["y"].clip(upper=clip)
    counts, edges = np.histogram(values, bins=20)
    rows = A.histogram(df, "y", 20, clip=clip).orderBy("bin").collect()
    assert [r["count"] for r in rows] == list(counts)
    assert np.allclose([r.low for r in rows], edges[:-1]) and np.allclose([r.high for r in rows], edges[1:])


def test_histogram_of_one_value_and_by_group(spark, numbers):
    one = A.histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), "v", 4).orderBy("bin").collect()
    assert [r["count"] for r in one] == list(np.histogram([2.0] * 3, bins=4)[0])
    pdf, df = numbers
    got = A.histogram(df, "y", 10, ["g"]).orderBy("g", "bin").collect()
    want = [c for _, g in pdf.groupby("g") for c in np.histogram(g["y"], bins=10)[0]]
    assert [r["count"] for r in got] == want


def test_box_stats_match_their_definition(numbers):
    pdf, df = numbers
    got = {r.g: r for r in A.box_stats(df, "g", "y").collect()}
    for key, group in pdf.groupby("g"):
        q1, q3 = group["y"].quantile([0.25, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = group["y"][group["y"].between(lo, hi)]
        r = got[key]
        assert np.allclose([r.q1, r.q3, r.whisker_low, r.whisker_high], [q1, q3, inside.min(), inside.max()])
        assert r.n_outliers == len(group) - len(inside)


def test_counts_and_duplicates(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", None), (None, "2"), ("b", "2")], "k string, s string")
    assert [(r.k, r["count"]) for r in A.value_counts(df, "k", 5).collect()] == [("a", 2), ("b", 2)]
    assert tuple(A.duplicate_summary(df, "k").first()) == (2, 4)
    assert tuple(A.duplicate_summary(df.limit(0), "k").first()) == (0, 0)
    assert A.distinct_keys(df, ["k", "s"]).first().n == 2


def test_conflicts_keep_null_keys(spark):
    rows = [("a", None, 1.0), ("a", None, 4.0), ("b", "x", 2.0)]
    df = spark.createDataFrame(rows, "sub string, ses string, age double")
    got = {(r.sub, r.ses): r.range for r in A.conflict_range(df, ["sub", "ses"], "age").collect()}
    assert got == {("a", None): 3.0, ("b", "x"): 0.0}


def test_top_reports(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", -3.0), ("c", None), ("d", 2.0)], "k string, v double")
    assert [r.k for r in top_k(df, "v", 2, ["k"]).collect()] == ["b", "a"]
    assert [r.k for r in top_k(df, "v", 2, ["k"], True).collect()] == ["d", "a"]
    assert [r.k for r in top_abs(df, "v", ["k"], 2).collect()] == ["b", "d"]
    assert take_exact(df, ["k"], 4).count() == 4
    with pytest.raises(TooFewRowsError):
        take_exact(df, ["k"], 5)
