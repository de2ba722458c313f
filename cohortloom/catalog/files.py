"""Readers and writers, on files that Spark writes from the driver's tables."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F

from cohortloom.catalog.base import IMAGE_SQL, images, register, table
from cohortloom.operators.joins import exclude
from cohortloom.operators.aggregates import score_means
from cohortloom.session import working_path
from cohortloom.sources.files import (
    list_or_scan,
    read_exclusions,
    scan_files,
    with_md5,
    write_list,
)
from cohortloom.sources.nifti import extract_headers
from cohortloom.sources.sinks import write_csv, write_report
from cohortloom.sources.tables import (
    read_delimited,
    read_image_index,
    read_qc_long,
    read_qc_wide,
    read_regional,
    row_map,
)
from cohortloom.streaming.index import run_available


@register("A1", "C3", sql="select distinct source as dataset, lang as suffix from documents")
def file_inventory(spark, sf):
    root = working_path(spark, "inventory")
    docs = table(spark, sf, "documents").select("source", "lang", F.col("doc_id").cast("string").alias("value"))
    docs.write.partitionBy("source", "lang").text(root)
    found = scan_files(spark, root, "*.txt", "bidsignore")
    parts = F.split("path", "/")
    return found.select(
        F.replace(F.get(parts, F.lit(0)), F.lit("source="), F.lit("")).alias("dataset"),
        F.replace(F.get(parts, F.lit(1)), F.lit("lang="), F.lit("")).alias("suffix"),
    ).distinct()


@register("A2", sql=f"select path from ({IMAGE_SQL}) where suffix = 'en'")
def stored_file_list(spark, sf):
    stored = working_path(spark, "list")
    write_list(images(spark, sf).filter("suffix = 'en'"), stored)
    return list_or_scan(spark, "unused", stored)


@register(
    "A3",
    "A9",
    sql="""select source as dataset, lpad(cast(doc_id as varchar), 8, '0') as sub, nullif(cast(doc_id % 2 as varchar), '1') as ses,
             lang as suffix, n_chars + 12 as voxels, cast(0.5 + doc_id % 4 as double) as slice, n_chars as size, md5(text) as md5 from documents""",
)
def image_index_csv(spark, sf):
    """Index rows written with array columns, read back with ids as text."""
    i = F.col("doc_id")
    rows = table(spark, sf, "documents").select(
        F.col("source").alias("dataset"),
        F.lpad(i.cast("string"), 8, "0").alias("sub"),
        F.nullif((i % 2).cast("string"), F.lit("1")).alias("ses"),
        F.col("lang").alias("suffix"),
        F.array(F.col("n_chars"), F.lit(12)).alias("shape"),
        F.array(F.lit(1.0), (0.5 + i % 4).cast("double")).alias("pixdim"),
        F.lit("int16").alias("dtype"),
        F.lit("RAS").alias("orient"),
        F.col("n_chars").alias("size"),
        F.md5(F.col("text").cast("binary")).alias("md5"),
        F.concat("source", F.lit("/"), i.cast("string")).alias("path"),
    )
    path = working_path(spark, "index")
    write_csv(rows, path)
    return read_image_index(spark, path).select(
        "dataset",
        "sub",
        "ses",
        "suffix",
        (F.get("shape", F.lit(0)) + F.get("shape", F.lit(1))).alias("voxels"),
        F.round(F.get("pixdim", F.lit(1)), 2).alias("slice"),
        "size",
        "md5",
    )


@register("A5", "C2", sql="select doc_id, source from documents where source not in ('src3', 'src7', 'src11')")
def exclusion_list(spark, sf):
    path = working_path(spark, "exclusions")
    sources = table(spark, sf, "documents").select("source").distinct()
    comment = F.when(F.col("source").isin("src3", "src7", "src11"), F.concat(F.lit("- "), "source", F.lit("  # bad")))
    sources.select(comment.otherwise(F.concat(F.lit("# keep "), "source")).alias("value")).write.text(path)
    listed = read_exclusions(spark, path, "source")
    return exclude(table(spark, sf, "documents"), listed, ["source"]).select("doc_id", "source")


@register(
    "A7",
    sql="""select event_type as scan, user_id as region, round(sum(value), 4) as volume from events group by 1, 2""",
)
def regional_tables(spark, sf):
    """Volumes of one scan per file group; the scan is found in the path."""
    root = working_path(spark, "regional")
    sums = table(spark, sf, "events").groupBy("event_type", F.col("user_id").alias("region"))
    sums = sums.agg(F.round(F.sum("value"), 4).alias("volume_mm3"))
    sums.repartition("event_type").write.partitionBy("event_type").csv(root, sep="\t", header=True)
    rows = read_regional(spark, f"{root}/*/*.csv")
    return rows.select(
        F.regexp_extract("path", "event_type=([^/]*)", 1).alias("scan"),
        F.col("region").cast("long").alias("region"),
        F.col("volume_mm3").alias("volume"),
    )


def _score_files(spark, sf):
    """Two directories of wide score tables with different columns."""
    root = working_path(spark, "scores")
    rows = table(spark, sf, "lineitem")
    first = rows.filter("l_linenumber <= 3").select(F.col("l_orderkey").alias("subject"), "l_quantity", "l_tax")
    second = rows.filter("l_linenumber > 3").select("l_discount", F.col("l_orderkey").alias("subject"), "l_quantity")
    first.write.csv(f"{root}/first", header=True)
    second.write.csv(f"{root}/second", header=True)
    return [f"{root}/first", f"{root}/second"]


_SCORES_SQL = """
  select case when l_linenumber <= 3 then 'first' else 'second' end as directory, l_orderkey as subject, l_quantity,
         case when l_linenumber > 3 then l_discount end as l_discount, case when l_linenumber <= 3 then l_tax end as l_tax from lineitem"""


@register("A8", "H1", sql=_SCORES_SQL)
def score_tables_wide(spark, sf):
    wide = read_qc_wide(spark, _score_files(spark, sf), pattern="*.csv")
    return wide.withColumn("subject", F.col("subject").cast("long"))


@register(
    "A8",
    "E11",
    "H4",
    sql=f"""select directory, score, round(avg(value), 6) as mean, count(*) as n from (
              select directory, 'l_quantity' as score, l_quantity as value from ({_SCORES_SQL})
              union all select directory, 'l_discount', l_discount from ({_SCORES_SQL}) where directory = 'second'
              union all select directory, 'l_tax', l_tax from ({_SCORES_SQL}) where directory = 'first') group by 1, 2""",
)
def score_table_means(spark, sf):
    long = read_qc_long(spark, _score_files(spark, sf), pattern="*.csv")
    means = score_means(long, ["directory", "score"], "value", rows="n")
    return means.withColumn("mean", F.round("mean", 6))


_QUOTED_SQL = """replace(replace(coalesce(text, ''), ' of ', ' "of", '), ', ', concat(',', chr(9), '""', chr(10)))"""


@register(
    "A4",
    "A7",
    "A8",
    sql=f"""select doc_id, md5(t) as md5, length(t) - length(replace(t, chr(10), '')) as n_breaks,
              length(t) - length(replace(t, '"', '')) as n_quotes, lang from (select doc_id, lang, {_QUOTED_SQL} as t from documents)""",
)
def quoted_records(spark, sf):
    """Whole texts as quoted fields with line breaks, quotes and separators, in files that are cut into blocks."""
    path = working_path(spark, "quoted")
    rows = table(spark, sf, "documents").select("doc_id", F.expr(_QUOTED_SQL.replace("chr(", "char(")).alias("t"), "lang")
    rows.repartition(2, "doc_id").write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        records = read_delimited(spark, path, ",")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    m = row_map(F.col("header"), F.col("fields"))
    back = records.select(m["doc_id"].cast("long").alias("doc_id"), m["t"].alias("t"), m["lang"].alias("lang"))

    def count(x):
        return (F.char_length("t") - F.char_length(F.replace("t", F.lit(x), F.lit("")))).cast("long")

    return back.select("doc_id", F.md5(F.col("t").cast("binary")).alias("md5"), count("\n").alias("n_breaks"), count('"').alias("n_quotes"), "lang")


@register(
    "A10",
    sql="""select user_id, count(*) as n, min(value) as low, max(value) as high, cast(null as double) as gap, cast(null as double) as listed_gap, cast(null as double) as undefined from events group by 1""",
)
def nested_report(spark, sf):
    path = working_path(spark, "report")
    rows = table(spark, sf, "events").groupBy("user_id").agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.struct(F.min("value").alias("low"), F.max("value").alias("high"), F.lit(float("nan")).alias("gap")).alias("range")).alias("data"),
        F.array(F.lit(float("nan"))).alias("gaps"),
        F.lit(float("nan")).alias("undefined"),
    )
    write_report(rows, path)
    schema = "user_id long, data struct<n: long, range: struct<low: double, high: double, gap: double>>, gaps array<double>, undefined double"
    back = spark.read.schema(schema).json(path)
    return back.select("user_id", "data.n", "data.range.low", "data.range.high", "data.range.gap", F.get("gaps", F.lit(0)).alias("listed_gap"), "undefined")


@register("A13", sql="select page_id, md5(url) as md5, case when page_id % 4 > 0 then md5(html) end as html_md5 from pages")
def content_digest(spark, sf):
    pages = with_md5(table(spark, sf, "pages"), "url")
    some = pages.withColumn("html", F.when(F.col("page_id") % 4 > 0, F.col("html")))
    return with_md5(some, "html", "html_md5").select("page_id", "md5", "html_md5")


def _as_volume_file(batches):
    """A NIfTI-1 header per row, so that the reader has something to read."""
    for pdf in batches:
        out = []
        for i, n in zip(pdf["doc_id"], pdf["n_chars"]):
            raw = bytearray(352)
            struct.pack_into("<i", raw, 0, 348)
            struct.pack_into("<8h", raw, 40, 3, 10 + i % 50, 20 + n % 60, 30, 1, 1, 1, 1)
            struct.pack_into("<h", raw, 70, 4 if i % 2 else 16)
            struct.pack_into("<8f", raw, 76, 1, 0.5 + i % 3, 1.25, 2, 0, 0, 0, 0)
            struct.pack_into("<2h", raw, 252, 0, 1)
            struct.pack_into("<12f", raw, 280, -1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)
            out.append(bytes(raw) if i % 10 else b"no header")
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "content": out})


@register(
    "A12",
    "K6",
    sql="""select doc_id, case when doc_id % 10 > 0 then concat('[', 10 + doc_id % 50, ',', 20 + n_chars % 60, ',30]') end as shape,
             case when doc_id % 10 > 0 then cast(0.5 + doc_id % 3 as double) end as voxel, case when doc_id % 10 > 0 then
             case when doc_id % 2 = 1 then 'int16' else 'float32' end end as dtype,
             case when doc_id % 10 > 0 then 'LAS' end as orient, case when doc_id % 10 = 0 then 'not a NIfTI header' end as header_error
           from documents""",
)
def image_headers(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    files = docs.mapInPandas(_as_volume_file, "doc_id long, content binary")
    return extract_headers(files).select(
        "doc_id",
        F.to_json("shape").alias("shape"),
        F.get("pixdim", F.lit(0)).alias("voxel"),
        "dtype",
        "orient",
        "header_error",
    )


@register("A11", sql="select doc_id, md5(text) as md5 from documents")
def streamed_index(spark, sf):
    """The index as a stream that stops when it is up to date; a second run adds nothing."""
    root = working_path(spark, "stream")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = f"{root}/out"
    for _ in range(2):
        stream = spark.readStream.schema(docs.schema).parquet(f"{sf}/documents.parquet*")
        run_available(
            stream, lambda s: with_md5(s, "text").select("doc_id", "md5"), out, f"{root}/checkpoint"
        )
    return spark.read.parquet(out)
