"""Joins, gates, positions and reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.catalog.base import FOLDS_SQL, IMAGE_SQL, VOLUME_SQL, images, register, table, volumes
from cohortloom.functions.names import capture, swap_suffix
from cohortloom.operators.aggregates import qc_summary
from cohortloom.operators.filters import (
    below_threshold,
    complete_categories,
    qc_gate,
    require_category,
)
from cohortloom.operators.folds import group_kfold
from cohortloom.operators.joins import (
    attach_group,
    attach_predictions,
    join_11,
    join_m1,
    keyed_join,
    lookup,
    lookup_with_reasons,
    pair_files,
)
from cohortloom.operators.ordering import take_exact
from cohortloom.operators.positions import batch_slice, kfold, with_position
from cohortloom.operators.quality import key_violations
from cohortloom.operators.reshape import (
    long_to_wide,
    normalize_by_reference,
    union_all,
    unpivot_scores,
    wide_to_long,
)
from cohortloom.sources.files import incremental_index

REGIONS = list(range(1, 8))


@register(
    "D1",
    sql="""select o_orderkey, o_custkey, c_mktsegment, c_custkey is not null as matched
           from orders left join (select * from customer where c_custkey % 3 > 0) c on o_custkey = c_custkey""",
)
def orders_with_customer(spark, sf):
    people = table(spark, sf, "customer").filter("c_custkey % 3 > 0")
    people = people.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return join_m1(orders, people, ["o_custkey"], match_flag="matched", check="later")


@register(
    "J2",
    sql="select l_orderkey, l_linenumber, count(*) as n_rows from lineitem group by 1, 2 having count(*) > 1",
)
def repeated_keys(spark, sf):
    return key_violations(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register(
    "H3",
    "D2",
    sql=f"""
      with v as ({VOLUME_SQL}),
      w as (select scan, {", ".join(f"max(volume) filter (where region = {r}) as volume__{r}" for r in REGIONS)}
            from v group by 1)
      select scan, o_orderpriority, {", ".join(f"volume__{r}" for r in REGIONS)} from w join orders on scan = o_orderkey""",
)
def wide_volumes_with_orders(spark, sf):
    long = volumes(spark, sf)
    wide = long_to_wide(long, ["scan"], "region", "volume", REGIONS, check="later")
    wide = wide.withColumnsRenamed({str(r): f"volume__{r}" for r in REGIONS})
    meta = table(spark, sf, "orders").select(F.col("o_orderkey").alias("scan"), "o_orderpriority")
    return join_11(meta, wide, ["scan"], check="later")


@register(
    "D3",
    sql=f"""select scan, region, volume, nullif(o_orderstatus, 'P') as status from ({VOLUME_SQL})
            join orders on scan = o_orderkey where nullif(o_orderstatus, 'P') is not null""",
)
def volumes_with_status(spark, sf):
    status = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("scan"), F.nullif("o_orderstatus", F.lit("P")).alias("status")
    )
    return lookup(volumes(spark, sf), status, ["scan"], "status", check="later")


_SKIP_SQL = """
  with n as (select event_id, user_id, case when event_id % 6 = 0 then 'other' else concat('sub-', user_id) end as name from events),
  t as (select c_custkey, nullif(c_mktsegment, 'BUILDING') as segment from customer where c_custkey % 4 > 0)
  select event_id, segment, case when name = 'other' then 'no match'
           when c_custkey is null then concat(user_id, ' not in the table') when segment is null then 'segment missing' end as reason
  from n left join t on case when name = 'other' then null else user_id end = c_custkey"""


def _skips(spark, sf):
    name = F.when(F.col("event_id") % 6 == 0, "other").otherwise(
        F.concat(F.lit("sub-"), F.col("user_id").cast("string"))
    )
    named = table(spark, sf, "events").select("event_id", name.alias("name"))
    named = capture(named, "name", r"^sub-(\d+)$", ["id"])
    people = table(spark, sf, "customer").filter("c_custkey % 4 > 0")
    people = people.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"),
    )
    return lookup_with_reasons(
        named,
        people,
        ["id"],
        F.col("segment"),
        F.col("id").isNotNull(),
        (F.lit("no match"), F.concat("id", F.lit(" not in the table")), F.lit("segment missing")),
    ).select("event_id", "segment", "reason")


@register("D4", "J1", sql=_SKIP_SQL)
def lookup_reasons(spark, sf):
    return _skips(spark, sf)


@register(
    "G7",
    sql=f"select event_id, reason from ({_SKIP_SQL}) where reason is not null order by event_id limit 20",
)
def first_skip_reasons(spark, sf):
    return _skips(spark, sf).filter("reason is not null").orderBy("event_id").limit(20).select("event_id", "reason")


_QC_SQL = """
  select l_orderkey as scan, min(l_discount) as qc_min, round(avg(l_discount), 6) as qc_mean from lineitem
  where l_orderkey % 3 > 0 group by 1"""


def _gated(spark, sf):
    scores = table(spark, sf, "lineitem").filter("l_orderkey % 3 > 0")
    qc = qc_summary(scores, ["l_orderkey"], "l_discount").withColumnRenamed("l_orderkey", "scan")
    qc = qc.withColumn("qc_mean", F.round("qc_mean", 6))
    return keyed_join(volumes(spark, sf), qc, ["scan"], "left")


@register(
    "D5",
    sql=f"select scan, region, volume, qc_min, qc_mean from ({VOLUME_SQL}) left join ({_QC_SQL}) q using (scan)",
)
def optional_scores(spark, sf):
    return _gated(spark, sf).select("scan", "region", "volume", "qc_min", "qc_mean")


@register(
    "C9",
    sql=f"""select scan, region, qc_min from ({VOLUME_SQL}) left join ({_QC_SQL}) q using (scan)
            where coalesce(qc_min >= 0.02, true)""",
)
def score_gate(spark, sf):
    return _gated(spark, sf).filter(qc_gate(F.col("qc_min"), 0.02)).select("scan", "region", "qc_min")


@register(
    "C10",
    sql=f"select scan, region, volume from ({VOLUME_SQL}) where scan in (select l_orderkey from lineitem where l_linenumber = 7)",
)
def scans_with_reference(spark, sf):
    return require_category(volumes(spark, sf), ["scan"], "region", 7)


@register(
    "C11",
    sql="""select l_orderkey, score, value from (
             select l_orderkey, 'l_discount' as score, l_discount as value from lineitem
             union all select l_orderkey, 'l_tax', nullif(l_tax, 0) from lineitem) where value < 0.03""",
)
def low_scores(spark, sf):
    wide = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_discount", F.nullif("l_tax", F.lit(0.0)).alias("l_tax")
    )
    return below_threshold(unpivot_scores(wide, "l_orderkey"), "value", 0.03)


@register(
    "C12",
    sql="""
      with c as (select event_type, user_id, nullif(count(*), 7) as n from events group by 1, 2),
      ok as (select user_id from c group by 1 having count(n) = (select count(distinct event_type) from c))
      select event_type, user_id, n from c where user_id in (select user_id from ok)""",
)
def complete_regions(spark, sf):
    counts = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    blanked = counts.withColumn("n", F.nullif("n", F.lit(7)))
    return complete_categories(blanked, "event_type", "user_id", "n").select("event_type", "user_id", "n")


@register(
    "B20",
    sql=f"""select scan, region, round(volume / nullif(max(volume) filter (where region = 1) over (partition by scan), 0), 6) as ratio
            from ({VOLUME_SQL}) qualify region <> 1""",
)
def volume_ratios(spark, sf):
    out = normalize_by_reference(volumes(spark, sf), ["scan"], "region", "volume", 1)
    return out.select("scan", "region", F.round("ratio", 6).alias("ratio"))


@register(
    "F2",
    sql="""select event_id, row_number() over (order by value, event_id) as place,
             row_number() over (partition by event_type order by value, event_id) as place_in_type,
             count(*) over (partition by event_type) as n_in_type from events""",
)
def event_positions(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "value")
    ranked = with_position(rows, ["value", "event_id"], ["event_type"], "place_in_type", "n_in_type")
    ranked = with_position(ranked, ["value", "event_id"], name="place")
    return ranked.select("event_id", "place", "place_in_type", "n_in_type")


@register(
    "F3",
    sql=f"select doc_id, path from ({IMAGE_SQL}) order by path limit 50 offset 100",
)
def listing_batch(spark, sf):
    rows = images(spark, sf).select("doc_id", "path")
    return batch_slice(rows, ["path"], 2, 50)


@register(
    "F5",
    sql="select event_id, cast(ntile(7) over (order by ts, event_id) as int) as fold from events",
)
def contiguous_folds(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "ts")
    return kfold(rows, 7, ["ts", "event_id"]).select("event_id", "fold")


@register(
    "F6",
    sql=f"""with recursive {FOLDS_SQL}
      select fold, count(*) as n_groups, cast(sum(n) as bigint) as n_rows from w join g using (r) group by 1""",
)
def grouped_fold_loads(spark, sf):
    """Groups and rows per fold: every group is in one fold, so the group counts add up."""
    rows = table(spark, sf, "lineitem").select("l_suppkey")
    folded = group_kfold(rows, "l_suppkey", 5)
    groups = folded.groupBy("l_suppkey", "fold").agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy("fold").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_rows"))


@register("F6", sql=f"with recursive {FOLDS_SQL} select l_suppkey, fold from gf")
def grouped_folds(spark, sf):
    """Fold of each group; within a size class the assignment follows the group id."""
    rows = table(spark, sf, "lineitem").select("l_suppkey")
    return group_kfold(rows, "l_suppkey", 5).distinct()


@register(
    "H1",
    sql="""select o_orderkey as id, o_totalprice as price, cast(null as double) as balance from orders
           union all select c_custkey, null, c_acctbal from customer""",
)
def aligned_union(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    people = table(spark, sf, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("id"))
    return union_all([orders, people])


@register(
    "H2",
    sql="""select l_orderkey, l_partkey, wave, age from (
             select l_orderkey, l_partkey, l_linenumber, 'wave1' as wave, nullif(l_quantity, 5) as age from lineitem
             union all select l_orderkey, l_partkey, l_linenumber, 'wave2', nullif(l_discount, 0) from lineitem
             union all select l_orderkey, l_partkey, l_linenumber, 'wave3', nullif(l_tax, 0) from lineitem) where age is not null""",
)
def waves_to_rows(spark, sf):
    wide = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        F.nullif("l_quantity", F.lit(5.0)).alias("a1"),
        F.nullif("l_discount", F.lit(0.0)).alias("a2"),
        F.nullif("l_tax", F.lit(0.0)).alias("a3"),
    )
    waves = {"wave1": "a1", "wave2": "a2", "wave3": "a3"}
    return wide_to_long(wide, ["l_orderkey", "l_partkey"], waves, "wave", "age", check=False)


@register(
    "A11",
    "D8",
    "H5",
    sql=f"select doc_id, path from ({IMAGE_SQL}) where doc_id not in (select doc_id from labels)",
)
def new_paths(spark, sf):
    listing = images(spark, sf).select("doc_id", "path")
    done = listing.join(table(spark, sf, "labels"), "doc_id", "left_semi")
    return incremental_index(listing, done)


@register(
    "D9",
    sql="""
      with seg as (select o_orderkey, concat(o_orderkey, '_synthseg.nii.gz') as name from orders),
      raw as (select c_custkey, concat(c_custkey, '.nii.gz') as raw_name from customer)
      select o_orderkey, name, raw_name, c_custkey from seg join raw on replace(name, '_synthseg.nii.gz', '.nii.gz') = raw_name""",
)
def raw_and_segmented(spark, sf):
    seg = table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit("_synthseg.nii.gz")).alias("name")
    )
    raw = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit(".nii.gz")).alias("raw_name")
    )
    return pair_files(seg, raw, swap_suffix(F.col("name"), "_synthseg.nii.gz", ".nii.gz"), "raw_name")


@register(
    "D12",
    sql="""select o_orderkey, o_totalprice as label, round(o_totalprice * 2, 6) as predicted from orders where o_orderkey % 5 > 0""",
)
def predictions_by_key(spark, sf):
    labels = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("label"))
    predicted = table(spark, sf, "orders").filter("o_orderkey % 5 > 0")
    predicted = predicted.select("o_orderkey", F.round(F.col("o_totalprice") * 2, 6).alias("predicted"))
    return attach_predictions(labels, predicted, "o_orderkey")


@register(
    "D13",
    sql="""select event_id, user_id % 5 as fold, a.alpha from events join
             (select user_id % 5 as f, max(value) as alpha from events group by 1) a on user_id % 5 = a.f""",
)
def fold_parameters(spark, sf):
    rows = table(spark, sf, "events").select("event_id", (F.col("user_id") % 5).alias("fold"), "value")
    alphas = rows.groupBy("fold").agg(F.max("value").alias("alpha"))
    return attach_group(rows.drop("value"), alphas, ["fold"])


@register("G4", sql="select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 100")
def exactly_100(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return take_exact(rows, ["o_totalprice", "o_orderkey"], 100)
