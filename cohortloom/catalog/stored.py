"""Stored tables, rejects counted on the way, and rules read from a file."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.catalog.base import IMAGE_SQL, JOINED_SQL, images, named_files, NAME_SQL, register, table
from cohortloom.functions.names import parse_entities
from cohortloom.operators.aggregates import conflict_range
from cohortloom.operators.constraints import check_rules, read_rules, with_violations
from cohortloom.operators.joins import join_m1, semi
from cohortloom.operators.quality import divide
from cohortloom.session import working_path
from cohortloom.sources.bucketed import index_new, read_stored, write_stored


def _stored_images(spark, sf, keys, rows=None):
    path = working_path(spark, "stored")
    write_stored(images(spark, sf) if rows is None else rows, path, keys, 8)
    return path


@register("D1", "D7", sql=f"select doc_id, dataset, sub, age, sex, matched from ({JOINED_SQL}) where dataset <> 'src1'")
def stored_index_with_people(spark, sf):
    """Index and participants, both stored by subject, are joined where they lie."""
    index = read_stored(spark, _stored_images(spark, sf, ["dataset", "sub"]))
    labels = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    people = labels.select(
        F.col("source").alias("dataset"), F.col("doc_id").cast("string").alias("sub"), F.col("quality").alias("age"), F.col("toxic").alias("sex")
    )
    path = working_path(spark, "people")
    known = write_stored(people, path, ["dataset", "sub"], 8)
    wanted = index.select("dataset").distinct().filter("dataset <> 'src1'")
    joined = join_m1(index, known, ["dataset", "sub"], match_flag="matched", check="later")
    return semi(joined, wanted, ["dataset"]).select("doc_id", "dataset", "sub", "age", "sex", "matched")


@register("A11", "D8", "H5", sql=f"select path, md5, size, path in (select path from ({IMAGE_SQL}) where doc_id % 3 > 0) as known from ({IMAGE_SQL})")
def stored_index_brought_up_to_date(spark, sf):
    """Two thirds are stored; the anti-join with the listing shuffles the listing only, and the rest is added."""
    every = images(spark, sf).select("path", "md5", "size")
    known = images(spark, sf).filter("doc_id % 3 > 0").select("path", "md5", "size", F.lit(True).alias("known"))
    path = _stored_images(spark, sf, ["path"], known)

    def describe(new):
        return new.join(every, "path").withColumn("known", F.lit(False))

    for _ in range(2):
        index = index_new(every.select("path"), path, "path", describe)
    return index.select("path", "md5", "size", "known")


@register(
    "J1",
    "J4",
    "E16",
    "C4",
    sql=f"""
      with n as (select *, regexp_replace(split_part(split_part(path, '/', -1), '.', 1), '_[^_]*$', '') as stem, split_part(path, '/', -2) as kind from ({NAME_SQL})),
      r as (select *, case when kind <> 'anat' then 'not anatomical' when size < 500 then 'too small' when stem not like '%\\_run-%' escape '\\'
                      and stem like '%\\_acq-%' escape '\\' then 'acquisition without run' end as reason from n)
      select x.reason, count(r.reason) as n, any_value(t.n_rows) as n_rows, any_value(t.n_good) as n_good, any_value(t.n_large) as n_large
      from (select unnest(['not anatomical', 'too small', 'acquisition without run']) as reason) x left join r on r.reason = x.reason,
           (select count(*) as n_rows, count(*) filter (where reason is null) as n_good, count(*) filter (where size > 3000) as n_large from r) t
      group by 1""",
)
def rejects_counted_on_the_way(spark, sf):
    """Good rows and rejects are written in one job that counts them by reason."""
    rows = parse_entities(named_files(spark, sf)).drop("reject_reason")
    has = F.map_contains_key
    rules = [
        (F.col("datatype") == "anat", "not anatomical"),
        (F.col("size") >= 500, "too small"),
        (has("entities", "run") | ~has("entities", "acq"), "acquisition without run"),
    ]
    got = divide(rows, rules, working_path(spark, "divided"), {"large": F.col("size") > 3000})
    told = {r["reject_reason"]: r["n"] for r in got.bad.groupBy("reject_reason").agg(F.count("*").alias("n")).collect()}
    if got.good.count() != got.n_good or told != {k: v for k, v in got.reasons.items() if v}:
        raise RuntimeError("observed counts differ from the written rows")
    numbers = {"n_rows": got.n_rows, "n_good": got.n_good, "n_large": got.masks["large"]}
    return got.counts().select("reason", "n", *[F.lit(v).cast("long").alias(k) for k, v in numbers.items()])


_RULES = [
    ("has_dates", "column", "l_shipdate,l_nothing", "", ""),
    ("known_flag", "one_of", "l_returnflag", "A|N", ""),
    ("known_status", "pattern", "l_linestatus", "[A-N]", ""),
    ("no_discount_on_tax", "sql", "", "l_discount + l_tax <= 0.15", "l_returnflag = 'R'"),
    ("one_line", "unique", "l_orderkey,l_linenumber", "", ""),
    ("one_part_of_a", "unique", "l_partkey", "", "l_returnflag = 'A'"),
    ("quantity", "range", "l_quantity", "2..45", ""),
    ("small_tax", "range", "l_tax,l_discount", "..0.07", "l_quantity > 10"),
    ("supplier", "not_null", "l_suppkey", "", ""),
]


def _rules(spark):
    path = working_path(spark, "rules")
    spark.createDataFrame(_RULES, "rule string, kind string, columns string, value string, `where` string").coalesce(1).write.csv(path, header=True, escape='"')
    return read_rules(spark, path)


@register(
    "C4",
    "C14",
    "J2",
    sql="""
      with l as (select *, count(*) over (partition by l_orderkey, l_linenumber) as k1,
                   count(*) filter (where l_returnflag = 'A') over (partition by l_partkey) as k2 from lineitem)
      select 'has_dates' as rule, 'column' as kind, 2::bigint as n_rows, 1::bigint as n_broken
      union all select 'known_flag', 'one_of', count(*), count(*) filter (where l_returnflag not in ('A', 'N')) from l
      union all select 'known_status', 'pattern', count(*), count(*) filter (where not regexp_full_match(l_linestatus, '[A-N]')) from l
      union all select 'no_discount_on_tax', 'sql', count(*), count(*) filter (where l_discount + l_tax > 0.15) from l where l_returnflag = 'R'
      union all select 'one_line', 'unique', count(*), count(*) filter (where k1 > 1) from l
      union all select 'one_part_of_a', 'unique', count(*), count(*) filter (where k2 > 1) from l where l_returnflag = 'A'
      union all select 'quantity', 'range', count(*), count(*) filter (where l_quantity not between 2 and 45) from l
      union all select 'small_tax', 'range', count(*), count(*) filter (where l_tax > 0.07 or l_discount > 0.07) from l where l_quantity > 10
      union all select 'supplier', 'not_null', count(*), count(*) filter (where l_suppkey is null) from l""",
)
def rules_from_a_file(spark, sf):
    return check_rules(table(spark, sf, "lineitem"), _rules(spark))


@register(
    "C4",
    "J1",
    "J2",
    sql="""
      with l as (select *, count(*) over (partition by l_orderkey, l_linenumber) as k1,
                   count(*) filter (where l_returnflag = 'A') over (partition by l_partkey) as k2 from lineitem)
      select concat_ws(',', case when l_returnflag not in ('A', 'N') then 'known_flag' end, case when not regexp_full_match(l_linestatus, '[A-N]') then 'known_status' end,
               case when l_returnflag = 'R' and l_discount + l_tax > 0.15 then 'no_discount_on_tax' end, case when k1 > 1 then 'one_line' end,
               case when l_returnflag = 'A' and k2 > 1 then 'one_part_of_a' end, case when l_quantity not between 2 and 45 then 'quantity' end,
               case when l_quantity > 10 and (l_tax > 0.07 or l_discount > 0.07) then 'small_tax' end) as violations, count(*) as n from l group by 1""",
)
def rows_by_violations(spark, sf):
    marked = with_violations(table(spark, sf, "lineitem"), _rules(spark))
    return marked.groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("n"))


@register(
    "E3",
    sql="""select sub, ses, round(max(age) - min(age), 6) as range from (
             select user_id as sub, nullif(event_type, 'click') as ses, value as age from events) group by 1, 2 having max(age) > min(age)""",
)
def value_conflicts(spark, sf):
    """Subjects and sessions, the missing session one of them, whose values differ."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("sub"), F.nullif("event_type", F.lit("click")).alias("ses"), F.col("value").alias("age"))
    spread = conflict_range(rows, ["sub", "ses"], "age").filter("range > 0")
    return spread.withColumn("range", F.round("range", 6))
