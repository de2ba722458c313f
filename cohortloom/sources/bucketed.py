"""Tables stored by key: joins and groupings on that key read their side without an exchange.

An index that is joined to its listing, its participants or its outputs again and again is written once in buckets
of a hash of the key. Spark then knows how the rows lie: a join on the key shuffles only the other side, or neither
when both are stored alike, and a check that the key is unique needs no shuffle at all. How a table is
stored is kept beside its files, so a later session finds it without a metastore.

A bucket is never split. The key should be fine enough that no bucket outgrows a task; :func:`largest_bucket` tells.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.operators.joins import keyed_join


def _name(path: str) -> str:
    return "stored_" + hashlib.md5(path.rstrip("/").encode()).hexdigest()


def write_stored(df: DataFrame, path: str, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Write ``df`` to the new folder ``path`` in ``buckets`` buckets of ``keys`` and return the stored table.

    One file per bucket, sorted by the key. By default there are as many buckets as shuffle partitions; use a
    multiple of that for tables beyond a few hundred megabytes a bucket.
    """
    spark, keys = df.sparkSession, list(keys)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spec = {"keys": keys, "buckets": buckets, "schema": df.schema.jsonValue()}
    _add(df, path, spec, "errorifexists")
    spark.createDataFrame([(json.dumps(spec),)], "spec string").coalesce(1).write.text(f"{path.rstrip('/')}/spec")
    return read_stored(spark, path)


def _add(df: DataFrame, path: str, spec: dict, mode: str) -> None:
    # dealt as the buckets are, a task writes one file and not one for each bucket
    dealt = df.repartition(spec["buckets"], *spec["keys"])
    writer = dealt.write.format("parquet").mode(mode).option("path", f"{path.rstrip('/')}/data")
    writer.bucketBy(spec["buckets"], *spec["keys"]).sortBy(*spec["keys"]).saveAsTable(_name(path))


def _spec(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path.rstrip('/')}/spec").first()[0])


def _declare(spark: SparkSession, path: str, spec: dict) -> str:
    """Make the stored files known to the session, by the name that goes with their folder."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        schema = T.StructType.fromJson(spec["schema"])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        keys = ", ".join(f"`{k}`" for k in spec["keys"])
        folder = f"{path.rstrip('/')}/data".replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys})"
            f" INTO {spec['buckets']} BUCKETS LOCATION '{folder}'"
        )
    return name


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """A table written by :func:`write_stored`, by this session or another."""
    name = _declare(spark, path, _spec(spark, path))
    spark.catalog.refreshTable(name)
    return spark.table(name)


def append_stored(df: DataFrame, path: str) -> DataFrame:
    """Add rows, dealt like those that are there; columns are matched by name."""
    spark = df.sparkSession
    spec = _spec(spark, path)
    _declare(spark, path, spec)
    _add(df.select(*[f["name"] for f in spec["schema"]["fields"]]), path, spec, "append")
    return read_stored(spark, path)


def largest_bucket(spark: SparkSession, path: str) -> int:
    """Rows of the fullest bucket."""
    spec = _spec(spark, path)
    bucket = F.pmod(F.hash(*spec["keys"]), F.lit(spec["buckets"]))
    sizes = read_stored(spark, path).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def index_new(listing: DataFrame, path: str, key: str, describe) -> DataFrame:
    """Bring the stored index at ``path`` up to date and return it.

    ``describe`` makes index rows of those rows of ``listing`` whose ``key`` is not stored yet; only the listing is
    shuffled for that. A run that is lost half-way has added nothing, for a write is committed as a whole.
    """
    stored = read_stored(listing.sparkSession, path)
    new = keyed_join(listing, stored.select(key), [key], "left_anti")
    return append_stored(describe(new), path)
