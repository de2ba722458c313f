"""Work plans, outcomes and subset manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.catalog.base import NAME_SQL, named_files, register, table
from cohortloom.functions.names import plan_paths
from cohortloom.plans.evaluation import age_labels
from cohortloom.plans.workplan import OUTPUTS, manifest, outcome, plan_work, work_status

# how far each scan got follows from its number: k = doc_id / 2
_STATUS_SQL = """case when k % 2 = 1 then 'register' when k % 4 > 0 then 'segment' when k % 8 > 0 then 'mask only' else 'done' end"""


def _inputs(spark, sf):
    rows = named_files(spark, sf).filter(F.col("path").endswith(".nii.gz"))
    return rows.select("doc_id", F.concat(F.lit("cohort/"), "path").alias("path"))


def _listing(spark, sf):
    """Inputs plus the outputs that exist so far."""
    inputs = _inputs(spark, sf)
    planned = plan_paths(inputs, "cohort").withColumn("k", F.floor(F.col("doc_id") / 2))
    each = F.array(*[F.struct(F.lit(o).alias("output"), F.col(o).alias("path")) for o in OUTPUTS])
    rows = planned.select("k", F.inline(each))
    there = (
        (F.col("output").isin("processed", "xfm") & (F.col("k") % 2 == 0))
        | (F.col("output").isin("seg", "vol", "qc") & (F.col("k") % 4 == 0))
        | ((F.col("output") == "mask") & (F.col("k") % 8 == 0))
    )
    return inputs.select("path").unionByName(rows.filter(there).select("path"))


@register(
    "D11",
    sql=f"""select doc_id, {_STATUS_SQL} as status from (select doc_id, cast(floor(doc_id / 2) as bigint) as k from documents where doc_id % 2 = 0)""",
)
def scan_status(spark, sf):
    plan = plan_paths(_inputs(spark, sf), "cohort")
    return work_status(plan, _listing(spark, sf), "cohort").select("doc_id", "status")


@register(
    "J3",
    "F3",
    "C13",
    sql=f"""select path, {_STATUS_SQL} as status from (
              select concat('cohort/', path) as path, cast(floor(doc_id / 2) as bigint) as k from ({NAME_SQL})
              where ends_with(path, '.nii.gz') order by string_split(concat('cohort/', path), '/') limit 40 offset 40)""",
)
def batch_work_plan(spark, sf):
    return plan_work(_listing(spark, sf), "cohort", 1, 40).select("path", "status")


@register(
    "J4",
    sql="""select event_type as stage, case when value > 100 then 'failed' else 'ok' end as status, count(*) as n
           from events group by 1, 2""",
)
def run_outcome(spark, sf):
    status = F.when(F.col("value") > 100, "failed").otherwise("ok")
    return outcome(table(spark, sf, "events").select(F.col("event_type").alias("stage"), status.alias("status")))


@register(
    "J5",
    "G4",
    sql=f"""select row_number() over (order by string_split(path, '/')) as index, split_part(path, '/', -1) as filename, path as source_path,
              concat('subset/', split_part(path, '/', -1)) as symlink_path
            from (select path from ({NAME_SQL}) order by string_split(path, '/') limit 100)""",
)
def subset_manifest(spark, sf):
    return manifest(named_files(spark, sf), 100, "subset")


_LABEL_SQL = """
  with f as (select event_id, user_id, case when event_id % 9 = 0 then 'note' else concat('sub-', user_id, '_ses-wave', event_id % 3 + 1, '_', event_id) end as pat_id,
               event_id % 3 as w from events),
  t as (select c_custkey, nullif(c_nationkey, 3) as a1, nullif(c_nationkey, 4) as a2, cast(c_nationkey + 1 as int) as a3 from customer where c_custkey % 5 > 0),
  j as (select pat_id, user_id, w, c_custkey, case w when 0 then a1 when 1 then a2 else a3 end as age
        from f left join t on case when pat_id = 'note' then null else user_id end = c_custkey)"""


def _labels(spark, sf):
    i, user = F.col("event_id"), F.col("user_id").cast("string")
    name = F.when(i % 9 == 0, "note").otherwise(
        F.concat(F.lit("sub-"), user, F.lit("_ses-wave"), (i % 3 + 1).cast("string"), F.lit("_"), i.cast("string"))
    )
    files = table(spark, sf, "events").select(F.concat(F.lit("processed/"), name, F.lit(".nii.gz")).alias("path"))
    nation = F.col("c_nationkey")
    people = table(spark, sf, "customer").filter("c_custkey % 5 > 0").select(
        F.concat(F.lit("sub-"), F.col("c_custkey").cast("string")).alias("participant_id"),
        F.when(nation != 3, nation.cast("string")).otherwise("N/A").alias("AgeMRI_W1"),
        F.when(nation != 4, nation.cast("string")).alias("AgeMRI_W2"),
        (nation + 1).cast("string").alias("AgeMRI_W3"),
    )
    return age_labels(files, people)


@register("B24", "D4", sql=f"{_LABEL_SQL} select pat_id, cast(age * 12 as double) as label from j where age is not null")
def evaluation_labels(spark, sf):
    return _labels(spark, sf)[0]


@register(
    "D4",
    "J1",
    sql=f"""{_LABEL_SQL} select pat_id, case when pat_id = 'note' then 'filename did not match DLBS pattern'
             when c_custkey is null then concat('sub-', user_id, ' not in participants.tsv')
             else concat('AgeMRI_W', w + 1, ' missing') end as reason from j where age is null""",
)
def evaluation_skips(spark, sf):
    return _labels(spark, sf)[1]
