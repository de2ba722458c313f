"""Stored tables: no exchange on the stored side, the same answers, found again, added to."""

import pytest
from pyspark.sql import functions as F

from cohortloom.operators.joins import join_m1, keyed_join
from cohortloom.operators.quality import DuplicateKeyError, key_violations
from cohortloom.sources.bucketed import _name, append_stored, index_new, largest_bucket, read_stored, write_stored


def exchanges(df):
    """Hash exchanges of the executed plan, and whether a scan is read by buckets."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    return plan.count("Exchange hashpartitioning"), plan.count("Bucketed: true")


@pytest.fixture
def shuffled(spark):
    """Joins that are too large to be broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def images(spark, n=3000):
    return spark.range(n).selectExpr("concat('ds', id % 40) as dataset", "cast(id % 700 as string) as sub", "concat('p', id) as path", "id as size")


def people(spark):
    return spark.range(700).selectExpr("concat('ds', id % 40) as dataset", "cast(id as string) as sub", "id % 90 as age")


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_two_stored_tables_join_without_exchange(spark, tmp_path, shuffled):
    index = write_stored(images(spark), str(tmp_path / "index"), ["dataset", "sub"], 8)
    known = write_stored(people(spark), str(tmp_path / "people"), ["dataset", "sub"], 8)
    joined = join_m1(index, known, ["dataset", "sub"], match_flag="matched", check="later")
    assert exchanges(joined) == (0, 2)
    plain = join_m1(images(spark), people(spark), ["dataset", "sub"], match_flag="matched")
    assert exchanges(plain)[0] == 2 and same(joined, plain)
    assert exchanges(key_violations(index, ["dataset", "sub"]))[0] == 0
    counted = index.groupBy("dataset", "sub").agg(F.count("*").alias("n"))
    assert exchanges(counted) == (0, 1)
    with pytest.raises(DuplicateKeyError):
        join_m1(known, index, ["dataset", "sub"])


def test_only_the_other_side_is_shuffled(spark, tmp_path, shuffled):
    write_stored(images(spark), str(tmp_path / "index"), ["path"], 8)
    index = read_stored(spark, str(tmp_path / "index"))
    listing = spark.range(2500, 3500).selectExpr("concat('p', id) as path")
    for how in ("left_anti", "left_semi", "left"):
        joined = keyed_join(listing, index, ["path"], how)
        assert exchanges(joined) == (1, 1)
        assert same(joined, keyed_join(listing, images(spark), ["path"], how))


def test_found_by_another_session(spark, tmp_path, shuffled):
    path = str(tmp_path / "a folder's index")
    write_stored(images(spark), path, ["path"], 4)
    spark.sql(f"drop table {_name(path)}")
    again = read_stored(spark, path)
    assert same(again, images(spark)) and exchanges(again.groupBy("path").count()) == (0, 1)
    assert largest_bucket(spark, path) < 3000 / 4 * 1.3
    other = spark.newSession()
    assert read_stored(other, path).count() == 3000


def test_rows_are_added_once(spark, tmp_path, shuffled):
    path = str(tmp_path / "index")
    asked = []

    def describe(new):
        asked.append(new.count())
        return new.select(F.lit(1).cast("long").alias("size"), "path", F.lit("s").alias("sub"), F.lit("d").alias("dataset"))

    write_stored(images(spark, 100), path, ["path"], 4)
    listing = spark.range(50, 130).selectExpr("concat('p', id) as path")
    for total in (130, 130):
        index = index_new(listing, path, "path", describe)
        assert index.count() == total and index.select("path").distinct().count() == total
    assert asked == [30, 0]
    spark.sql(f"drop table {_name(path)}")
    more = append_stored(images(spark, 131).filter("size = 130"), path)
    assert more.count() == 131 and exchanges(more.groupBy("path").count()) == (0, 1)


def test_a_folder_is_not_overwritten(spark, tmp_path):
    write_stored(images(spark, 10), str(tmp_path / "t"), ["path"], 2)
    with pytest.raises(Exception, match="exists|EXISTS"):
        write_stored(images(spark, 10), str(tmp_path / "t"), ["path"], 2)
    empty = write_stored(images(spark, 0), str(tmp_path / "e"), ["path"], 2)
    assert empty.count() == 0 and largest_bucket(spark, str(tmp_path / "e")) == 0
