"""Names, paths and scalar projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.catalog.base import (
    IMAGE_SQL,
    NAME_SQL,
    VOLUME_SQL,
    images,
    named_files,
    register,
    table,
    volumes,
)
from cohortloom.config import DOWNLOAD_RULES, OUTPUT_DIRECTORIES, SCAN_NAME_PATTERN, TEMPLATE_SPACE
from cohortloom.functions.names import (
    capture,
    first_token,
    parse_entities,
    path_rules,
    plan_paths,
    promote,
    scan_identifier,
    swap_suffix,
)
from cohortloom.functions.scalars import (
    feature_label,
    months_to_years,
    volume_column,
    with_errors,
    years_to_months,
)
from cohortloom.operators.filters import outside_directories, visible_images
from cohortloom.operators.ordering import path_key
from cohortloom.operators.positions import with_position
from cohortloom.operators.quality import split_valid
from cohortloom.operators.reshape import constant, in_order

_PARSED_SQL = f"""
  with n as ({NAME_SQL}),
  p as (select doc_id, path, split_part(path, '/', 1) as dataset, split_part(path, '/', -2) as datatype,
               split_part(path, '/', -1) as name from n),
  s as (select *, split_part(name, '.', 1) as stem from p),
  r as (select *, case when datatype <> 'anat' then concat('invalid datatype ', datatype)
                       when not contains(stem, '_') then 'name without a suffix'
                       when regexp_matches(regexp_replace(stem, '_[^_]*$', ''), '(^|_)[^_]*-[^_]*-[^_]*')
                       then 'entity with more than one dash' end as reject_reason,
               split_part(stem, '_', -1) as suffix from s)"""


@register(
    "B1",
    sql=f"""{_PARSED_SQL}
      select doc_id, dataset, datatype, suffix,
             nullif(regexp_extract(regexp_replace(stem, '_[^_]*$', ''), '(^|_)sub-([^_]*)', 2), '') as sub,
             case when contains(regexp_replace(stem, '_[^_]*$', ''), '_run-2') then '2'
                  when contains(regexp_replace(stem, '_[^_]*$', ''), '_run-1') then '1' end as run,
             nullif(regexp_extract(regexp_replace(stem, '_[^_]*$', ''), '_ses-([^_]*)', 1), '') as ses
      from r where reject_reason is null""",
)
def entity_names(spark, sf):
    good, _ = split_valid(parse_entities(named_files(spark, sf)))
    return promote(good, ["sub", "run", "ses"]).select(
        "doc_id", "dataset", "datatype", "suffix", "sub", "run", "ses"
    )


@register("C4", "J1", sql=f"{_PARSED_SQL} select doc_id, path, reject_reason from r where reject_reason is not null")
def entity_rejects(spark, sf):
    _, bad = split_valid(parse_entities(named_files(spark, sf)))
    return bad.select("doc_id", "path", "reject_reason")


@register(
    "B21",
    "B23",
    sql="""
      with n as (select user_id, event_id, concat('sub-', cast(user_id as varchar), '_ses-',
                   case when event_id % 4 = 3 then 'base' else concat('wave', cast(event_id % 4 + 1 as varchar)) end,
                   '_', event_type, '_T1w') as name from events)
      select event_id, regexp_extract(name, '^(sub-[^_]+)_ses-(wave[123])_', 1) as participant,
             regexp_extract(name, '^(sub-[^_]+)_ses-(wave[123])_', 2) as wave, name as pat_id
      from n where regexp_matches(name, '^(sub-[^_]+)_ses-(wave[123])_')""",
)
def scan_name_capture(spark, sf):
    wave = F.when(F.col("event_id") % 4 == 3, "base").otherwise(
        F.concat(F.lit("wave"), (F.col("event_id") % 4 + 1).cast("string"))
    )
    participant = F.concat(F.lit("sub-"), F.col("user_id").cast("string"))
    named = table(spark, sf, "events").select(
        "event_id", scan_identifier(participant, wave, F.col("event_type")).alias("pat_id")
    )
    got = capture(named, "pat_id", SCAN_NAME_PATTERN, ["participant", "wave"])
    return got.filter(F.col("participant").isNotNull())


@register(
    "B22",
    sql=f"""
      with n as ({NAME_SQL}), s as (select doc_id, path,
        regexp_replace(split_part(path, '/', -1), '\\.nii\\.gz$', '') as stem from n)
      select doc_id, concat('cohort/processed/', stem, '_space-{TEMPLATE_SPACE}_desc-processed.nii.gz') as processed,
        concat('cohort/derivatives/masks/', stem, '_space-{TEMPLATE_SPACE}_desc-brain_mask.nii.gz') as mask,
        concat('cohort/derivatives/transforms/', stem, '_from-native_to-{TEMPLATE_SPACE}_mode-image_xfm.mat') as xfm,
        concat('cohort/derivatives/synthseg/', stem, '_desc-synthseg_dseg.nii.gz') as seg,
        concat('cohort/derivatives/synthseg/', stem, '_volumes.csv') as vol,
        concat('cohort/derivatives/synthseg/', stem, '_qc.csv') as qc from s""",
)
def output_paths(spark, sf):
    planned = plan_paths(named_files(spark, sf), "cohort")
    return planned.select("doc_id", "processed", "mask", "xfm", "seg", "vol", "qc")


@register(
    "B27",
    "B28",
    sql=f"""select doc_id, replace(path, '.nii.gz', '_qc.tsv') as sibling,
                   split_part(split_part(path, '/', -1), '_', 1) as token from ({NAME_SQL})""",
)
def sibling_names(spark, sf):
    path = F.col("path")
    return named_files(spark, sf).select(
        "doc_id",
        swap_suffix(path, ".nii.gz", "_qc.tsv").alias("sibling"),
        first_token(F.substring_index(path, "/", -1)).alias("token"),
    )


@register(
    "A14",
    sql="""
      with u as (select page_id, concat(regexp_replace(url, '[?#].*$', ''),
        case page_id % 7 when 0 then '/participants.tsv' when 1 then '/sub-1_T1w.nii.gz'
             when 2 then '/derivatives/x_T1w.nii.gz' when 3 then '/x_desc-preproc_T2w.nii.gz'
             when 4 then '/x_FLAIR.json' when 5 then '/.bidsignore_T1w.txt' else '/readme.txt' end) as path from pages)
      select page_id, path from u
      where (path like '%\\_T1w.%' escape '\\' or path like '%\\_T2w.%' escape '\\'
             or path like '%\\_FLAIR.%' escape '\\' or path like '%participants.%')
        and not (path like '%bidsignore%' or path like '%derivatives%' or path like '%desc-preproc%')""",
)
def download_rules(spark, sf):
    endings = {
        0: "/participants.tsv",
        1: "/sub-1_T1w.nii.gz",
        2: "/derivatives/x_T1w.nii.gz",
        3: "/x_desc-preproc_T2w.nii.gz",
        4: "/x_FLAIR.json",
        5: "/.bidsignore_T1w.txt",
    }
    end = F.lit("/readme.txt")
    for k, v in endings.items():
        end = F.when(F.col("page_id") % 7 == k, v).otherwise(end)
    path = F.concat(F.regexp_replace("url", "[?#].*$", ""), end).alias("path")
    pages = table(spark, sf, "pages").select("page_id", path)
    return pages.filter(path_rules(F.col("path"), DOWNLOAD_RULES))


@register(
    "C3",
    sql="""select page_id, url from pages
           where not (split_part(url, '/', -1) like '.%') and not contains(url, 'ref=')""",
)
def visible_paths(spark, sf):
    return table(spark, sf, "pages").filter(visible_images(F.col("url"), "ref=")).select("page_id", "url")


@register(
    "C13",
    sql=f"""
      with n as (select doc_id, concat(case doc_id % 5 when 0 then 'processed/' when 1 then 'derivatives/'
                   when 2 then 'logs/' when 3 then 'processed_more/' else '' end, path) as path from ({NAME_SQL}))
      select doc_id, path from n
      where not (starts_with(path, 'processed/') or starts_with(path, 'derivatives/') or starts_with(path, 'logs/'))""",
)
def outside_outputs(spark, sf):
    prefix = F.lit("")
    for k, v in {0: "processed/", 1: "derivatives/", 2: "logs/", 3: "processed_more/"}.items():
        prefix = F.when(F.col("doc_id") % 5 == k, v).otherwise(prefix)
    files = named_files(spark, sf).select("doc_id", F.concat(prefix, "path").alias("path"))
    return files.filter(outside_directories(F.col("path"), OUTPUT_DIRECTORIES))


@register(
    "G1",
    sql=f"""select doc_id, path, row_number() over (order by string_split(path, '/')) as place
            from (select doc_id, case when doc_id % 2 = 0 then replace(path, '/', '-') else path end as path
                  from ({IMAGE_SQL}))""",
)
def path_order(spark, sf):
    path = F.when(F.col("doc_id") % 2 == 0, F.replace("path", F.lit("/"), F.lit("-"))).otherwise(F.col("path"))
    listed = images(spark, sf).select("doc_id", path.alias("path"))
    keyed = listed.withColumn("parts", path_key(F.col("path")))
    return with_position(keyed, ["parts"], name="place").drop("parts")


@register(
    "B19",
    sql=f"""select scan, region, concat('volume__', cast(region as varchar)) as feature,
                   concat(cast(region as varchar), ' / TIV') as ratio_label,
                   concat(cast(region as varchar), ' (mm^3)') as raw_label from ({VOLUME_SQL})""",
)
def feature_labels(spark, sf):
    name = volume_column(F.col("region").cast("string"))
    return volumes(spark, sf).select(
        "scan",
        "region",
        name.alias("feature"),
        feature_label(name, "icv-normalized").alias("ratio_label"),
        feature_label(name, "raw").alias("raw_label"),
    )


@register(
    "B18",
    sql=f"""select suffix, 'index' as stage, path as location, size, md5 from ({IMAGE_SQL})""",
)
def index_projection(spark, sf):
    kept = constant(images(spark, sf).drop("dataset", "sub", "doc_id"), stage="index")
    renamed = kept.withColumnsRenamed({"path": "location"})
    return in_order(renamed, ["size", "md5"])


@register(
    "B25",
    sql="""select event_id, round(value * 12, 6) as months, round(value / 12, 6) as years from events""",
)
def months_and_years(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        F.round(years_to_months(F.col("value")), 6).alias("months"),
        F.round(months_to_years(F.col("value")), 6).alias("years"),
    )


@register(
    "B26",
    sql="""select l_orderkey, l_partkey, l_linenumber, l_quantity, round(l_quantity - l_discount * 100, 6) as error,
                  round(abs(l_quantity - l_discount * 100), 6) as absolute_error from lineitem""",
)
def prediction_errors(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("label", F.col("l_discount") * 100)
    return with_errors(rows, "label", "l_quantity").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        "l_quantity",
        F.round("error", 6).alias("error"),
        F.round("absolute_error", 6).alias("absolute_error"),
    )
