"""Image files written from documents, and the way from files over the index to the cohort."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import functions as F

from cohortloom.catalog.base import register, table
from cohortloom.config import InclusionLimits
from cohortloom.plans.curation import curate
from cohortloom.plans.indexing import index_images
from cohortloom.session import materialize, working_path
from cohortloom.sources.files import list_or_scan, write_list
from cohortloom.sources.images import BATCH_FILES, write_files

# A NIfTI-1 header as hex text, the same expression in Spark and DuckDB: shape, type and voxel size follow from
# the length of the text, so that copies of a text are copies of a file. Values below 256 take one byte and a zero.
_SMALL = "concat(lpad(hex({0}), 2, '0'), '00')"
_X, _Y, _Z = "(110 + n_chars % 140)", "(115 + n_chars % 90)", "(70 + n_chars % 60)"
_HEADER = f"""concat('5C010000', repeat('00', 36),
  '0300', {_SMALL.format(_X)}, {_SMALL.format(_Y)}, {_SMALL.format(_Z)}, '0100010001000100', repeat('00', 14),
  case when n_chars % 2 = 1 then '0400' else '1000' end, repeat('00', 4),
  '0000803F', case when n_chars % 3 = 0 then '0000C03F' else '0000803F' end, '0000A03F', '00000040', repeat('00', 16),
  repeat('00', 144), '00000100', repeat('00', 24),
  '000080BF', repeat('00', 12), '00000000', '0000803F', repeat('00', 8), repeat('00', 8), '0000803F', repeat('00', 4), repeat('00', 24))"""
_PATH = """concat(source, '/sub-', lpad(cast(doc_id as {text}), 9, '0'), case when doc_id % 11 = 0 then '/func/' else '/anat/' end,
  'sub-', lpad(cast(doc_id as {text}), 9, '0'), '_', lang, case when doc_id % 4 = 1 then '.nii.gz' else '.nii' end)"""

#: Every document as a file: one in ten is cut within its header, one in four zipped, one in eleven misplaced.
_FILES_SQL = f"""
  select *, case when doc_id % 11 = 0 then 'invalid datatype func' when cut then 'not a NIfTI header' end as reason,
         case when cut then bytes[1:200] else bytes end as body
  from (select doc_id, source as dataset, lpad(cast(doc_id as varchar), 9, '0') as sub, lang as suffix, n_chars,
          {_PATH.format(text="varchar")} as path, doc_id % 10 = 3 as cut, doc_id % 4 = 1 as zipped,
          unhex({_HEADER}) || encode(coalesce(text, '')) as bytes from documents)"""


def _zipped(batches):
    for whole in batches:
        for i in range(0, whole.num_rows, BATCH_FILES):
            batch = whole.slice(i, BATCH_FILES)
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            content = [gzip.compress(raw, 1, mtime=0) if path.endswith(".gz") else raw for path, raw in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(content, pa.binary())], ["doc_id", "path", "content"])


def image_files(spark, sf):
    """``doc_id, path, content`` of every file."""
    docs = table(spark, sf, "documents").where("doc_id is not null")
    raw = F.concat(F.unhex(F.expr(_HEADER)), F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select("doc_id", F.expr(_PATH.format(text="string")).alias("path"), raw.alias("content"))
    cut = F.when(F.col("doc_id") % 10 == 3, F.substring("content", 1, 200)).otherwise(F.col("content"))
    return rows.withColumn("content", cut).mapInArrow(_zipped, "doc_id long, path string, content binary")


def _report(good, bad):
    """Both channels; digest and size of zipped files depend on the packer and are left out."""
    rows = good.unionByName(bad, allowMissingColumns=True)
    plain = F.col("path").endswith(".nii")
    return rows.select(
        "path", "dataset", "sub", "suffix", F.to_json("shape").alias("shape"),
        F.get("pixdim", F.lit(0)).alias("voxel_x"), F.get("pixdim", F.lit(2)).alias("voxel_z"), "dtype", "orient",
        F.when(plain, F.col("size")).alias("size"), F.when(plain, F.col("md5")).alias("md5"), "reject_reason",
    )


def _report_sql(lost: str) -> str:
    """``lost`` is the condition under which a listed file is not there."""
    header = f"not cut and not ({lost})"
    return f"""
      select path, dataset, sub, suffix,
        case when {header} then concat('[', {_X}, ',', {_Y}, ',', {_Z}, ']') end as shape,
        case when {header} then case when n_chars % 3 = 0 then 1.5::double else 1.0::double end end as voxel_x,
        case when {header} then 2.0::double end as voxel_z,
        case when {header} then case when n_chars % 2 = 1 then 'int16' else 'float32' end end as dtype,
        case when {header} then 'LAS' end as orient,
        case when not zipped and not ({lost}) then octet_length(body) end as size,
        case when not zipped and not ({lost}) then md5(body) end as md5,
        case when doc_id % 11 > 0 and ({lost}) then 'no such file' else reason end as reject_reason from ({_FILES_SQL})"""


@register("A1", "A11", "A12", "A13", "K6", "B1", "C3", "C4", "J1", sql=_report_sql("false"))
def indexed_images(spark, sf):
    """Files to index rows and rejects through the image source."""
    root = working_path(spark, "images")
    write_files(image_files(spark, sf), root)
    return _report(*index_images(spark, root))


@register("A2", "A12", "A13", "K6", sql=_report_sql("doc_id % 10 = 7"))
def indexed_list(spark, sf):
    """A stored list wins over the folder: files that it names and that are gone are rejects with a reason."""
    root, stored = working_path(spark, "listed"), working_path(spark, "list")
    files = image_files(spark, sf)
    write_list(files.select("path"), stored)
    write_files(files.where("doc_id % 10 <> 7"), root)
    return _report(*index_images(spark, root, listing=list_or_scan(spark, root, stored)))


@register("A1", "A2", "C3", sql=f"select path, case when not zipped then octet_length(body) end as size from ({_FILES_SQL})")
def scanned_list(spark, sf):
    """Without a stored list the folder is scanned and the list stored; sizes come from a second scan."""
    from cohortloom.sources.files import scan_files

    root, stored = working_path(spark, "scanned"), working_path(spark, "list")
    write_files(image_files(spark, sf), root)
    listed = list_or_scan(spark, root, stored)
    sizes = scan_files(spark, root)
    return listed.join(sizes, "path", "left").select("path", F.when(F.col("path").endswith(".nii"), F.col("size")).alias("size"))


_LIMITS = InclusionLimits(size_mb_low=0.0)
_COHORT_SQL = f"""
  with f as (select *, case when n_chars % 3 = 0 then 1.5 else 1.0 end as vx from ({_FILES_SQL})),
  ok as (select * from f where reason is null and suffix in ('en', 'fr') and dataset not in ('src3', 'src7')
         and {_X} * vx between 120 and 260 and {_Y} * 1.25 between 120 and 260 and {_Z} * 2.0 between 120 and 260
         and (zipped or octet_length(body) <= 60000000)),
  u as (select * from (select *, row_number() over (partition by md5(body), zipped order by string_split(path, '/')) as rn from ok) where rn = 1)"""


@register(
    "A12",
    "C2",
    "C5",
    "D1",
    "E18",
    "F1",
    sql=f"""{_COHORT_SQL}
      select count(distinct dataset) as n_datasets, count(distinct (dataset, sub)) as n_subjects, count(*) as n_images,
        count(*) filter (where suffix = 'en') as n_en, count(*) filter (where suffix = 'fr') as n_fr,
        (select count(*) from u join labels using (doc_id)) as n_matched from u""",
)
def indexed_cohort(spark, sf):
    """Files, index, curation and counts, as a user of the library runs them."""
    root = working_path(spark, "cohort")
    write_files(image_files(spark, sf), root)
    good, _ = index_images(spark, root)
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("dataset"))
    people = table(spark, sf, "labels").join(docs, "doc_id").select(
        "dataset", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("sub"), F.col("quality").alias("age"), F.col("toxic").alias("sex")
    )
    out = docs.select("dataset").where(F.col("dataset").isin("src3", "src7")).distinct()
    cohort = curate(good, people, out, _LIMITS, ("en", "fr"))
    matched = materialize(cohort.joined, "cohort").agg(F.count_if("matched").alias("n_matched")).scalar()
    return cohort.counts.withColumn("n_matched", matched)
