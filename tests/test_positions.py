import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortloom.operators.positions import (
    batch_slice,
    curve,
    ecdf,
    kfold,
    quantiles,
    rank_error,
    running_totals,
    with_position,
)


LIMITS = [1_000_000, 300, 7]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key and one value; keys and values may be NULL."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        hot = i % 3 == 0
        key = "hot" if hot else rng.choice(["a", "b", "c", "d", None])
        value = 5.0 if hot and i % 2 else rng.choice([None, round(rng.random() * 100, 1)])
        rows.append((i, key, value))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, key string, value double").repartition(7).cache()


@pytest.mark.parametrize("limits", LIMITS)
def test_positions_match_a_window(skewed, limits):
    for by in ([], ["key"]):
        got = with_position(skewed, ["value", "id"], by, total="n", range_rows=limits)
        w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
        both = got.withColumns(
            {"p": F.row_number().over(w.orderBy("value", "id")), "m": F.count(F.lit(1)).over(w)}
        )
        assert both.filter("position <> p or n <> m").count() == 0
        assert both.count() == 3000


def test_running_totals_match_a_window(skewed):
    got = running_totals(skewed, ["id"], {"s": F.col("id"), "h": (F.col("key") == "hot").cast("long")})
    w = Window.partitionBy(F.lit(1)).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    both = got.withColumns({"e": F.sum("id").over(w), "f": F.count_if(F.col("key") == "hot").over(w)})
    assert both.filter("s <> e or not (h <=> f) or s_total <> 4498500").count() == 0


def test_order_independence(skewed):
    want = sorted(map(tuple, with_position(skewed, ["value", "id"], ["key"]).collect()), key=str)
    limits = LIMITS[1]
    for n in (1, 17):
        again = with_position(skewed.repartition(n), ["value", "id"], ["key"], range_rows=limits)
        assert sorted(map(tuple, again.collect()), key=str) == want


@pytest.mark.parametrize("limits", LIMITS)
def test_quantiles_match_pandas(skewed, limits):
    pdf = skewed.toPandas()
    ps = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    want = pdf["value"].quantile(list(ps.values()))
    got = quantiles(skewed, "value", ps).first()
    assert np.allclose([got[n] for n in ps], want)
    by = {r.key: [r[n] for n in ps] for r in quantiles(skewed, "value", ps, ["key"], range_rows=limits).collect()}
    for key, group in pdf.groupby("key", dropna=False):
        assert np.allclose(by[None if pd.isna(key) else key], group["value"].quantile(list(ps.values())))


def test_median_of_even_count_is_interpolated(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert quantiles(rows, "v", {"m": 0.5}).first().m == 2.5


def test_ecdf_ends_at_one(skewed):
    rows = ecdf(skewed, "value", ["key"]).groupBy("key").agg(F.max("fraction").alias("m"))
    assert all(r.m == 1.0 for r in rows.collect())


def test_batches_partition_the_list(spark):
    rows = spark.range(103).withColumn("path", F.lpad(F.col("id").cast("string"), 4, "0"))
    got = [[r.id for r in batch_slice(rows, ["path"], b, 25).orderBy("path").collect()] for b in range(6)]
    assert [len(g) for g in got] == [25, 25, 25, 25, 3, 0]
    assert sum(got, []) == list(range(103))


def test_fold_sizes_differ_by_one_and_are_contiguous(spark):
    for n, k in ((13, 5), (10, 5), (3, 5), (100, 7)):
        rows = kfold(spark.range(n), k, ["id"]).orderBy("id").collect()
        folds = [r.fold for r in rows]
        assert folds == sorted(folds)
        want = [len(p) for p in np.array_split(np.arange(n), k)]
        assert [folds.count(f) for f in range(1, k + 1)] == want


def test_array_keys_can_be_ordered(spark):
    rows = spark.range(500).select(F.split(F.concat_ws("/", F.lit("a"), F.col("id").cast("string")), "/").alias("p"))
    got = with_position(rows, ["p"]).orderBy("p").collect()
    assert [r.position for r in got] == list(range(1, 501))


def test_very_many_groups_over_very_many_ranges(spark):
    rows = spark.range(15_000).selectExpr("id", "id % 5000 as g")
    got = with_position(rows, ["id"], ["g"], total="n", range_rows=100)
    assert got.filter("position <> id div 5000 + 1 or n <> 3").count() == 0 and got.count() == 15_000


def test_curve_at_fixed_points(skewed, spark):
    pdf = skewed.toPandas()
    got = curve(skewed, "value", ["key"], 11).toPandas()
    for key, group in pdf.groupby("key", dropna=False):
        part = got[got["key"].isna()] if pd.isna(key) else got[got["key"] == key]
        part, values = part.sort_values("fraction"), np.sort(group["value"].dropna())
        assert np.allclose(part["fraction"], np.linspace(0, 1, 11)) and part["value"].is_monotonic_increasing
        assert part["value"].iloc[0] == values[0] and part["value"].iloc[-1] == values[-1]
        below = np.searchsorted(values, part["value"], "left") / len(values)
        upto = np.searchsorted(values, part["value"], "right") / len(values)
        assert (np.maximum(below - part["fraction"], part["fraction"] - upto) <= rank_error() + 1 / len(values)).all()
    odd = spark.createDataFrame([("a", None), ("b", float("nan")), ("c", 2.0)], "g string, v double")
    assert [tuple(r) for r in curve(odd, "v", ["g"], 3).orderBy("fraction").collect()] == [("c", 0.0, 2.0), ("c", 0.5, 2.0), ("c", 1.0, 2.0)]
    assert curve(odd.filter("g <> 'c'"), "v").count() == 0
    with pytest.raises(ValueError):
        curve(odd, "v", points=1)


def test_curve_of_many_rows_keeps_its_error(spark):
    rows = spark.range(0, 200_000, 1, 9).selectExpr("pow(id, 3) * (id % 2 * 2 - 1) as v")
    got = curve(rows, "v", points=21, k=200).orderBy("fraction").collect()
    values = np.sort([i**3 * (i % 2 * 2 - 1) for i in range(200_000)])
    ranks = np.searchsorted(values, [r.v for r in got]) / len(values)
    assert np.abs(ranks - [r.fraction for r in got]).max() <= 2 * rank_error(200)
