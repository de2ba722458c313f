import pytest
from pyspark.sql import functions as F

from cohortloom.operators.dedup import dedup_first
from cohortloom.operators.filters import below_threshold, complete_categories, require_category
from cohortloom.operators.joins import (
    attach_group,
    coverage,
    exclude,
    join_m1,
    keyed_join,
    lookup_with_reasons,
    pair_files,
    semi,
)
from cohortloom.operators.quality import DuplicateKeyError, assert_unique, split_valid

SPREAD = 5


@pytest.fixture(scope="module")
def left(spark):
    k = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.col("id") % 40)
    return spark.range(900).select("id", k.cast("long").alias("k")).repartition(6, "id")


@pytest.fixture(scope="module")
def right(spark):
    return spark.range(0, 30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_change_nothing_in_the_result(left, right, how):
    want = left.join(right, ["k"], how)
    got = keyed_join(left, right, ["k"], how, spread=SPREAD)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_hot_key_is_spread_over_tasks(left, right, spark):
    """Also where the left side is already gathered by the key."""
    left = left.repartition("k")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = keyed_join(left, right, ["k"], "inner", spread=SPREAD).filter("k = 0")
        parts = got.select(F.spark_partition_id().alias("p")).distinct().count()
        plain = left.join(right, "k").filter("k = 0").select(F.spark_partition_id().alias("p")).distinct()
        assert plain.count() == 1 and parts > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_to_one_join_checks_the_right_side(left, right):
    twice = right.union(right.limit(1))
    with pytest.raises(DuplicateKeyError, match="repeat"):
        join_m1(left, twice, ["k"])
    with pytest.raises(Exception, match="repeat"):
        join_m1(left, twice, ["k"], check="later").collect()
    later = join_m1(left, right, ["k"], check="later")
    assert later.columns == join_m1(left, right, ["k"], check="none").columns and later.count() == left.count()
    joined = join_m1(left, right, ["k"], match_flag="found")
    assert joined.count() == left.count()
    c = coverage(joined, "found", ["v"]).first()
    assert c.n_matched == c.n_v == left.join(right, "k").count()


def test_exclusion_keeps_null_keys(left, spark):
    listed = spark.createDataFrame([(0,), (2,)], "k long")
    kept = exclude(left, listed, ["k"])
    assert kept.filter("k is null").count() == left.filter("k is null").count() > 0
    assert kept.filter("k in (0, 2)").count() == 0
    assert kept.count() + semi(left, listed, ["k"]).count() == left.count()


def test_reasons_come_in_order(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", None), ("c", "y"), ("d", "z")], "id string, k string")
    table = spark.createDataFrame([("x", 1), ("y", None)], "k string, v int")
    got = lookup_with_reasons(
        rows, table, ["k"], F.col("v"), F.col("k").isNotNull(), (F.lit("name"), F.lit("table"), F.lit("value"))
    )
    assert {r.id: r.reason for r in got.collect()} == {"a": None, "b": "name", "c": "value", "d": "table"}


def test_pairs_by_derived_name(spark):
    seg = spark.createDataFrame([("a_seg.nii",), ("b_seg.nii",)], "seg string")
    raw = spark.createDataFrame([("a.nii", 1), ("c.nii", 2)], "raw string, n int")
    got = pair_files(seg, raw, F.replace("seg", F.lit("_seg"), F.lit("")), "raw").collect()
    assert [(r.seg, r.raw, r.n) for r in got] == [("a_seg.nii", "a.nii", 1)]


def test_first_copy_in_order_with_null_keys_equal(spark):
    rows = [("x", 3), ("x", 1), (None, 5), (None, 4), ("y", 9)]
    df = spark.createDataFrame(rows, "k string, o int")
    for n in (1, 17):
        got = dedup_first(df.repartition(n), ["k"], ["o"])
        assert {(r.k, r.o) for r in got.collect()} == {("x", 1), (None, 4), ("y", 9)}


def test_dedup_limits_each_group_before_the_shuffle(spark):
    df = spark.createDataFrame([("x", 3)], "k string, o int")
    plan = dedup_first(df, ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_good_and_rejected_rows_are_the_input(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,), (5,)], "v int")
    good, bad = split_valid(df, [(F.col("v").isNotNull(), "missing"), (F.col("v") > 0, "negative")])
    assert sorted(r.v for r in good.collect()) == [1, 5]
    assert {(r.v, r.reject_reason) for r in bad.collect()} == {(-1, "negative"), (None, "missing")}


def test_unique_keys_treat_null_as_a_value(spark):
    df = spark.createDataFrame([(None,), (None,)], "k int")
    with pytest.raises(DuplicateKeyError):
        assert_unique(df, ["k"])


def test_regions_missing_in_one_scan_are_dropped(spark):
    rows = [("s1", "a", 1.0), ("s1", "b", 2.0), ("s2", "a", 3.0), ("s2", "b", None), ("s2", "c", 1.0)]
    df = spark.createDataFrame(rows, "scan string, region string, v double")
    assert {r.region for r in complete_categories(df, "scan", "region", "v").collect()} == {"a"}
    assert {r.scan for r in require_category(df, ["scan"], "region", "c").collect()} == {"s2"}


def test_nan_scores_never_flag(spark):
    df = spark.createDataFrame([(0.1,), (0.65,), (None,), (float("nan"),)], "v double")
    assert [r.v for r in below_threshold(df, "v").collect()] == [0.1]


def test_few_groups_stay_where_they_are(spark):
    rows = spark.range(3_000_000).withColumn("k", F.col("id") % 3)
    found = attach_group(rows, rows.groupBy("k").agg(F.max("id").alias("top")), ["k"], "inner")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert [tuple(r) for r in found.groupBy("k", "top").count().orderBy("k").collect()] == [(i, 2_999_997 + i, 1_000_000) for i in range(3)]
