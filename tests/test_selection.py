"""Radix selection against numpy and against the positions of sorted values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators.positions import quantiles
from cohortloom.operators.selection import first_digit, next_digit, select_quantiles

PS = {"a": 0.0, "b": 0.013, "c": 0.25, "d": 0.5, "e": 0.951, "f": 1.0}
EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, 1.0, -1.0, math.inf, -math.inf, 2.0**-1022, 3e-310]


def test_digits_grow_with_the_value(spark):
    rng = random.Random(1)
    xs = EDGES + [rng.choice([1, -1]) * rng.random() * 2.0 ** rng.randint(-1074, 1023) for _ in range(3000)]
    xs += [s * x for e in range(-1074, 1024, 7) for x in (2.0**e, math.nextafter(2.0**e, 0), math.nextafter(2.0**e, math.inf)) for s in (1, -1)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", first_digit(F.col("x")).alias("d")).collect()
    assert all(a.d <= b.d for a, b in zip(*[sorted(rows, key=lambda r: r.x)[i:] for i in (0, 1)]))
    spans = {}
    for r in rows:
        spans.setdefault(r.d, []).append(r.x)
    assert all(min(v) == max(v) or abs(max(v) / min(v) - 1) < 0.03 or abs(max(v)) < 1e-300 for v in spans.values())
    near = [1e9 + i / 7 for i in range(2000)]
    df = spark.createDataFrame([(x,) for x in near], "x double")
    digits = [r.d for r in df.select(next_digit(F.col("x"), F.lit(near[0]), F.lit(near[-1]), 9).alias("d")).collect()]
    assert digits == sorted(digits) and digits[0] == 0 and digits[-1] == 512 and len(set(digits)) > 500


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(4000):
        key = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{int(rng.integers(0, 300))}"
        kind = i % 5
        value = [rng.normal(), float(rng.integers(0, 5)), rng.normal() * 10.0 ** float(rng.integers(-300, 300)), -0.0, 1e6 + rng.random()][kind]
        rows.append((key, float(value), int(rng.integers(-(2**62), 2**62)), f"{rng.integers(0, 999)}.25"))
    rows += [("odd", None, None, None), ("odd", math.nan, None, None), ("one", 7.5, 3, "1.00"), ("inf", math.inf, 1, "1.00"), ("inf", 1.0, 2, "1.00")]
    df = spark.createDataFrame(rows, "key string, v double, w long, t string").repartition(5)
    return df.withColumn("c", F.col("t").cast("decimal(20,2)"))


@pytest.mark.parametrize("digit_bits", [16, 5])
def test_same_as_sorted_positions(skewed, digit_bits):
    for value in ("v", "w", "c"):
        got = {r.key: r for r in select_quantiles(skewed, value, PS, ["key"], "size", digit_bits).collect()}
        want = {r.key: r for r in quantiles(skewed.filter(~F.isnan("v")), value, PS, ["key"], "size").collect()}
        assert set(got) == set(want) and "odd" not in got and None in got
        for key, w in want.items():
            assert got[key]["size"] == w["size"]
            assert [repr(float(got[key][p]) + 0.0) for p in PS] == [repr(float(w[p]) + 0.0) for p in PS], (value, key)


@pytest.mark.parametrize("digit_bits", [16, 3])
def test_whole_table(skewed, digit_bits):
    finite = skewed.filter("key <> 'inf'")
    got = select_quantiles(finite, "v", PS, sizes="n", digit_bits=digit_bits).first()
    want = quantiles(finite, "v", PS, sizes="n").first()
    assert tuple(got) == tuple(want)
    values = [r.v for r in finite.filter("v is not null and not isnan(v)").select("v").collect()]
    assert np.allclose([got[p] for p in PS], np.quantile(values, list(PS.values())), rtol=1e-12)


def test_no_values(spark):
    none = spark.createDataFrame([("a", None), ("b", math.nan)], "g string, v double")
    assert tuple(select_quantiles(none, "v", PS).first()) == (None,) * len(PS)
    assert select_quantiles(none, "v", PS, ["g"]).count() == 0
    assert select_quantiles(none.withColumn("v", F.lit(3.5)), "v", {"m": 0.5}, ["g"]).orderBy("g").collect() == [("a", 3.5), ("b", 3.5)]


def test_values_are_not_moved(spark):
    rows = spark.range(100_000).select((F.col("id") * 0.37 % 811).alias("v"), (F.col("id") % 3).alias("g"))
    plan = select_quantiles(rows, "v", PS, ["g"])._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan
    got = select_quantiles(rows, "v", PS).first()
    assert np.allclose(list(got), np.quantile((np.arange(100_000) * 0.37) % 811, list(PS.values())))
