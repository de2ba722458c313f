"""The curated cohort and the steps on its way."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.catalog.base import IMAGE_SQL, JOINED_SQL, images, participants, register, table
from cohortloom.operators.aggregates import cohort_counts, overview
from cohortloom.operators.dedup import dedup_first
from cohortloom.operators.joins import coverage, exclude, join_m1
from cohortloom.operators.ordering import path_key
from cohortloom.plans.curation import dense_datasets, labelled_subjects, large_datasets

EXCLUDED = ("src3", "src7")
SUFFIXES = ("en", "fr")

_CURATED_SQL = f"""
  select * from (select i.*, row_number() over (partition by md5 order by path) as rn
                 from ({IMAGE_SQL}) i where source not in ('src3', 'src7') and n_chars between 100 and 20000) t
  where rn = 1""".replace("source not in", "dataset not in").replace("n_chars between", "size between")


def excluded(spark, sf):
    """Ids to leave out, as a table."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("dataset"))
    return docs.filter(F.col("dataset").isin(*EXCLUDED)).distinct()


def curated(spark, sf):
    chosen = exclude(images(spark, sf), excluded(spark, sf), ["dataset"])
    masked = chosen.filter(F.col("size").between(100, 20000))
    return dedup_first(masked, ["md5"], [path_key(F.col("path"))])


@register(
    "C2",
    "C5",
    "F1",
    "D1",
    "E18",
    sql=f"""
      select count(distinct dataset) as n_datasets, count(distinct (dataset, sub)) as n_subjects, count(*) as n_images,
             count(*) filter (where suffix = 'en') as n_en, count(*) filter (where suffix = 'fr') as n_fr,
             count(*) filter (where l.doc_id is not null) as n_matched, count(l.quality) as n_age
      from ({_CURATED_SQL}) c left join labels l on c.doc_id = l.doc_id""",
)
def flagship_cohort(spark, sf):
    """Exclude, mask, deduplicate by content, join many-to-one, count."""
    unique = curated(spark, sf)
    joined = join_m1(unique, participants(spark, sf), ["doc_id"], match_flag="matched", check="later")
    persons = joined.groupBy("dataset", "sub").agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if(F.col("suffix") == "en").alias("en"),
        F.count_if(F.col("suffix") == "fr").alias("fr"),
        F.count_if("matched").alias("matched"),
        F.count("age").alias("age"),
    )
    return persons.agg(
        F.count_distinct("dataset").alias("n_datasets"),
        F.count(F.lit(1)).alias("n_subjects"),
        *[F.sum(c).alias(f"n_{c}") for c in ("images", "en", "fr", "matched", "age")],
    )


@register(
    "E18",
    sql=f"""select count(distinct dataset) as n_datasets, count(distinct (dataset, sub)) as n_subjects, count(*) as n_images,
             count(*) filter (where suffix = 'en') as n_en, count(*) filter (where suffix = 'fr') as n_fr from ({IMAGE_SQL})""",
)
def suffix_counts(spark, sf):
    return cohort_counts(images(spark, sf), "dataset", "sub", "suffix", SUFFIXES)


@register("C1", sql=f"select doc_id, suffix from ({IMAGE_SQL}) where suffix in ('en', 'fr')")
def suffix_filter(spark, sf):
    return images(spark, sf).filter(F.col("suffix").isin(*SUFFIXES)).select("doc_id", "suffix")


@register(
    "C2",
    "D6",
    sql=f"""select doc_id, nullif(dataset, 'src5') as dataset from ({IMAGE_SQL}) where dataset not in ('src3', 'src7')""",
)
def excluded_datasets(spark, sf):
    rows = images(spark, sf).withColumn("dataset", F.nullif("dataset", F.lit("src5")))
    return exclude(rows, excluded(spark, sf), ["dataset"]).select("doc_id", "dataset")


@register("F1", sql=f"select path, md5 from ({_CURATED_SQL})")
def first_copies(spark, sf):
    return curated(spark, sf).select("path", "md5")


@register(
    "F1",
    sql="""select key, event_id, value from (
             select nullif(user_id, 3) as key, event_id, value,
                    row_number() over (partition by nullif(user_id, 3) order by value, event_id) as rn from events) t
           where rn = 1""",
)
def first_rows_null_keys(spark, sf):
    rows = table(spark, sf, "events").withColumn("key", F.nullif("user_id", F.lit(3)))
    return dedup_first(rows, ["key"], ["value", "event_id"]).select("key", "event_id", "value")


def joined(spark, sf):
    people = participants(spark, sf)
    return join_m1(images(spark, sf), people, ["doc_id"], match_flag="matched", check="later")


@register(
    "D10",
    sql=f"""select count(*) as n_rows, count(*) filter (where matched) as n_matched,
              count(age) as n_age, round(avg(case when age is null then 0.0 else 1.0 end), 6) as rate_age,
              count(sex) as n_sex, round(avg(case when sex is null then 0.0 else 1.0 end), 6) as rate_sex,
              count(*) filter (where age is not null and sex is not null) as n_all,
              round(avg(case when age is null or sex is null then 0.0 else 1.0 end), 6) as rate_all
            from (select matched, nullif(age, 0) as age, sex from ({JOINED_SQL}))""",
)
def join_coverage(spark, sf):
    rows = joined(spark, sf).withColumn("age", F.nullif("age", F.lit(0)))
    out = coverage(rows, "matched", ["age", "sex"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("rate_")})


_OVERVIEW_SQL = """
  select cast(o_custkey % 50 as varchar) as dataset, count(*) as n_images, count(distinct o_custkey) as n_subs,
         round(avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end), 6) as frac_labeled,
         round(count(*) / count(distinct o_custkey), 6) as im_per_sub
  from orders group by 1"""


def _order_overview(spark, sf):
    rows = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 50).cast("string").alias("dataset"),
        F.col("o_custkey").alias("sub"),
        F.col("o_orderkey").alias("path"),
        F.when(F.col("o_orderstatus") == "F", 1).alias("age"),
    )
    out = overview(rows, "dataset", "path", "sub", "age")
    return out.withColumns({c: F.round(c, 6) for c in ("frac_labeled", "im_per_sub")})


@register("E8", sql=_OVERVIEW_SQL)
def dataset_overview(spark, sf):
    return _order_overview(spark, sf)


@register(
    "C8",
    "G3",
    sql=f"""select dataset, n_subs from ({_OVERVIEW_SQL}) where n_subs >= 10 order by n_subs desc, dataset limit 20""",
)
def datasets_with_many_subjects(spark, sf):
    return large_datasets(_order_overview(spark, sf), 10, 20).select("dataset", "n_subs")


@register(
    "C8",
    "G3",
    sql=f"""select dataset, im_per_sub from ({_OVERVIEW_SQL}) where im_per_sub >= 10.2 order by im_per_sub desc, dataset limit 20""",
)
def datasets_with_many_images(spark, sf):
    return dense_datasets(_order_overview(spark, sf), 10.2, 20).select("dataset", "im_per_sub")


@register(
    "D7",
    sql="""
      with l as (select cast(o_custkey % 50 as varchar) as dataset, o_custkey as sub, o_orderkey, o_totalprice
                 from orders where o_orderstatus = 'F'),
      e as (select dataset from l group by 1 having count(distinct sub) >= 15)
      select dataset, sub, o_orderkey from (
        select *, row_number() over (partition by dataset, sub order by o_orderkey) as rn from l where dataset in (select dataset from e)) t
      where rn = 1""",
)
def eligible_subjects(spark, sf):
    """One labelled row per subject of the groups with enough labelled subjects."""
    rows = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 50).cast("string").alias("dataset"),
        F.col("o_custkey").alias("sub"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("path"),
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("age"),
    )
    return labelled_subjects(rows, 15).select("dataset", "sub", "o_orderkey")
