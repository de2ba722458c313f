"""Query registry and the views of the driver's tables that stand in for imaging tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None
    covers: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def register(*covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name; ``covers`` are survey ids."""

    def add(fn: Query) -> Query:
        REGISTRY[fn.__name__] = Entry(fn, sql, covers)
        return fn

    return add


def queries() -> dict[str, Query]:
    return {name: e.run for name, e in REGISTRY.items()}


def sql_texts() -> dict[str, str]:
    return {name: e.sql for name, e in REGISTRY.items() if e.sql}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- images: one row per document --------------------------------------------------------------

IMAGE_SQL = """
  select source as dataset, cast(doc_id as varchar) as sub, lang as suffix, n_chars as size,
         md5(text) as md5, concat(source, '/', cast(doc_id as varchar)) as path, doc_id
  from documents"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc_id = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("dataset"),
        doc_id.alias("sub"),
        F.col("lang").alias("suffix"),
        F.col("n_chars").alias("size"),
        F.md5(F.col("text").cast("binary")).alias("md5"),
        F.concat("source", F.lit("/"), doc_id).alias("path"),
        "doc_id",
    )


# --- structured file names, with the irregular ones the parser must handle -------------------------

NAME_SQL = """
  select doc_id, n_chars as size, concat(source, '/sub-', lpad(cast(doc_id as varchar), 9, '0'), '/',
         case when doc_id % 11 = 0 then 'func' else 'anat' end, '/sub-', lpad(cast(doc_id as varchar), 9, '0'),
         case when doc_id % 13 = 0 then '_acq-a-b' when doc_id % 5 = 0 then '_run-1_run-2'
              when doc_id % 3 = 0 then '_extra' when doc_id % 7 = 0 then '_acq-1.5mm' else '_ses-a' end,
         case when doc_id % 17 = 0 then '' else concat('_', lang) end,
         case when doc_id % 2 = 0 then '.nii.gz' else '.nii' end) as path
  from documents"""


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    sub = F.concat(F.lit("sub-"), F.lpad(i.cast("string"), 9, "0"))
    extra = (
        F.when(i % 13 == 0, "_acq-a-b")
        .when(i % 5 == 0, "_run-1_run-2")
        .when(i % 3 == 0, "_extra")
        .when(i % 7 == 0, "_acq-1.5mm")
        .otherwise("_ses-a")
    )
    path = F.concat(
        "source",
        F.lit("/"),
        sub,
        F.when(i % 11 == 0, "/func/").otherwise("/anat/"),
        sub,
        extra,
        F.when(i % 17 == 0, "").otherwise(F.concat(F.lit("_"), "lang")),
        F.when(i % 2 == 0, ".nii.gz").otherwise(".nii"),
    )
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("n_chars").alias("size"), path.alias("path"))


# --- regional volumes: one row per order and line number, summed ----------------------------------

VOLUME_SQL = """
  select l_orderkey as scan, l_linenumber as region, round(sum(l_extendedprice), 2) as volume
  from lineitem group by 1, 2"""


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("scan"), F.col("l_linenumber").alias("region"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("volume"))
    )


# --- grouped folds: largest group first, each to the lightest fold -----------------------------------

FOLDS_SQL = """
  g as (select l_suppkey, count(*) as n, row_number() over (order by count(*) desc, l_suppkey) as r from lineitem group by 1),
  w as (select cast(0 as bigint) as r, cast([0, 0, 0, 0, 0] as bigint[]) as loads, 0 as fold
        union all
        select g.r, list_transform(loads, lambda x, i: case when i = list_position(loads, list_min(loads)) then x + g.n else x end),
               cast(list_position(loads, list_min(loads)) as int)
        from w join g on g.r = w.r + 1),
  q as (select n, fold, count(*) as c from w join g using (r) group by 1, 2),
  b as (select n, fold, sum(c) over (partition by n order by fold) as hi, c from q),
  k as (select l_suppkey, n, row_number() over (partition by n order by l_suppkey) as rk from g),
  gf as (select k.l_suppkey, b.fold, k.n from k join b on k.n = b.n and k.rk > b.hi - b.c and k.rk <= b.hi)"""


# --- images joined to labels -----------------------------------------------------------------------

JOINED_SQL = f"""
  select i.*, l.quality as age, l.toxic as sex, l.doc_id is not null as matched
  from ({IMAGE_SQL}) i left join labels l on i.doc_id = l.doc_id"""


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("age"), F.col("toxic").alias("sex")
    )
