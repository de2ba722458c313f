"""Array geometry and masks on embeddings and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.catalog.base import IMAGE_SQL, JOINED_SQL, images, participants, register, table
from cohortloom.config import InclusionLimits, OutlierLimits
from cohortloom.functions.arrays import (
    array_product,
    axis,
    field_of_view,
    label_mask,
    n_dims,
    parse_list,
)
from cohortloom.functions.scalars import clip_upper, cubic_centimetres, megabytes
from cohortloom.operators.aggregates import mask_rates, with_log_count
from cohortloom.operators.filters import include_mask, outlier_masks
from cohortloom.operators.joins import lookup_or_hash
from cohortloom.plans.curation import with_geometry

# an image-like row per document: shape and voxel size follow from its number
_GEOMETRY_SQL = """
  select doc_id, lang as suffix, source as dataset,
    case when doc_id % 19 = 0 then list_value(256, 256) when doc_id % 23 = 0 then list_value(128, 128, 60, 4)
         else list_value(100 + doc_id % 200, 120 + doc_id % 160, 90 + doc_id % 130) end as shape,
    case when doc_id % 19 = 0 then list_value(1.0::double, 1.0::double)
         when doc_id % 23 = 0 then list_value(2.0::double, 2.0::double, 2.0::double, 1.0::double)
         when doc_id % 29 = 0 then list_value('nan'::double, 1.0::double, 1.0::double)
         else list_value((doc_id % 8) / 4.0::double, (doc_id % 7) / 4.0::double, (doc_id % 15) / 4.0::double) end as pixdim,
    n_chars * 10000 as size from documents"""


def geometry(spark, sf):
    i = F.col("doc_id")

    def longs(*cols):
        return F.array(*[(F.lit(c) if isinstance(c, int) else c).cast("long") for c in cols])

    def doubles(*cols):
        return F.array(*[(F.lit(c) if isinstance(c, float) else c).cast("double") for c in cols])

    shape = (
        F.when(i % 19 == 0, longs(256, 256))
        .when(i % 23 == 0, longs(128, 128, 60, 4))
        .otherwise(longs(100 + i % 200, 120 + i % 160, 90 + i % 130))
    )
    pixdim = (
        F.when(i % 19 == 0, doubles(1.0, 1.0))
        .when(i % 23 == 0, doubles(2.0, 2.0, 2.0, 1.0))
        .when(i % 29 == 0, doubles(float("nan"), 1.0, 1.0))
        .otherwise(doubles(i % 8 / F.lit(4.0), i % 7 / F.lit(4.0), i % 15 / F.lit(4.0)))
    )
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        F.col("lang").alias("suffix"),
        F.col("source").alias("dataset"),
        shape.alias("shape"),
        pixdim.alias("pixdim"),
        (F.col("n_chars") * 10000).alias("size"),
    )


@register(
    "B9",
    "B10",
    "B11",
    "B13",
    "B14",
    sql="""
      with e as (select vec_id, list_transform(embedding, lambda x: round(x::double * 10, 1)) as v from embeddings)
      select vec_id, cast(len(v) as int) as ndim, list_max(v) as largest, list_min(v) as smallest,
             v[1] as x, v[2] as y, v[3] as z, cast(null as double) as beyond,
             round(v[1] * v[2] * v[3], 6) as product from e""",
)
def array_geometry(spark, sf):
    text = F.to_json(F.transform("embedding", lambda x: F.round(x.cast("double") * 10, 1)))
    v = F.col("v")
    rows = table(spark, sf, "embeddings").select("vec_id", parse_list(text).alias("v"))
    return rows.select(
        "vec_id",
        n_dims(v).alias("ndim"),
        F.array_max(v).alias("largest"),
        F.array_min(v).alias("smallest"),
        axis(v, 0).alias("x"),
        axis(v, 1).alias("y"),
        axis(v, 2).alias("z"),
        axis(v, 64).alias("beyond"),
        F.round(array_product(F.slice(v, 1, 3)), 6).alias("product"),
    )


@register(
    "B12",
    sql=f"""
      with g as (select * replace (list_transform(pixdim, lambda x: case when isnan(x) then null else x end) as pixdim) from ({_GEOMETRY_SQL})), s as (select *, least(3, len(shape), len(pixdim)) as n from g)
      select doc_id, cast(len(shape) as int) as ndim, list_max(pixdim) as res, shape[1] * pixdim[1] as fov_x,
             shape[2] * pixdim[2] as fov_y, case when n >= 3 then shape[3] * pixdim[3] end as fov_z,
             round(shape[1] * pixdim[1] * shape[2] * pixdim[2] * case when n >= 3 then shape[3] * pixdim[3] else 1 end, 4) as vol
      from s""",
)
def fields_of_view(spark, sf):
    rows = with_geometry(geometry(spark, sf))
    fov = F.col("fov")
    return rows.select(
        "doc_id",
        "ndim",
        "res",
        axis(fov, 0).alias("fov_x"),
        axis(fov, 1).alias("fov_y"),
        axis(fov, 2).alias("fov_z"),
        F.round("vol", 4).alias("vol"),
    )


_MASK_SQL = """len(shape) = 3 and size / 1e6 >= 1 and size / 1e6 <= 60 and doc_id % 29 <> 0
  and list_min(pixdim) >= 0.3 and pixdim[1] <= 1.5 and pixdim[2] <= 1.5 and pixdim[3] <= 3
  and least(shape[1] * pixdim[1], shape[2] * pixdim[2], shape[3] * pixdim[3]) >= 120
  and greatest(shape[1] * pixdim[1], shape[2] * pixdim[2], shape[3] * pixdim[3]) <= 260"""


@register("C5", sql=f"select doc_id from ({_GEOMETRY_SQL}) where {_MASK_SQL}")
def inclusion_mask(spark, sf):
    return geometry(spark, sf).filter(include_mask(InclusionLimits())).select("doc_id")


@register(
    "E16",
    "C7",
    sql=f"""select cast(count(*) filter (where {_MASK_SQL}) as bigint) as n_include,
              round(avg(case when {_MASK_SQL} then 1.0 else 0.0 end), 6) as rate_include,
              count(*) filter (where len(shape) <> 3) as n_not_3d,
              round(avg(case when len(shape) <> 3 then 1.0 else 0.0 end), 6) as rate_not_3d,
              count(*) filter (where size < 100000) as n_very_small,
              round(avg(case when size < 100000 then 1.0 else 0.0 end), 6) as rate_very_small,
              count(*) filter (where size > 100000000) as n_very_big,
              round(avg(case when size > 100000000 then 1.0 else 0.0 end), 6) as rate_very_big
            from ({_GEOMETRY_SQL})""",
)
def quality_mask_rates(spark, sf):
    masks = {"include": include_mask(), **outlier_masks()}
    rates = mask_rates(geometry(spark, sf), masks)
    rounded = {c: F.round(c, 6) for c in rates.columns if c.startswith("rate_")}
    return rates.withColumns(rounded)


@register(
    "C7",
    sql=f"""select doc_id, size, len(shape) <> 3 as not_3d, size < 2000000 as very_small, size > 50000000 as very_big
            from ({_GEOMETRY_SQL}) where len(shape) <> 3 or size < 2000000 or size > 50000000""",
)
def size_outliers(spark, sf):
    masks = outlier_masks(OutlierLimits(2_000_000, 50_000_000))
    rows = geometry(spark, sf).withColumns(masks)
    return rows.filter("not_3d or very_small or very_big").select("doc_id", "size", *masks)


@register(
    "B15",
    "B16",
    sql=f"""select doc_id, round(n / 1e6, 6) as mb, round(n / 1e3, 6) as cm3,
              case when doc_id % 5 > 0 then least(n / 1e3, 3.0) end as clipped
            from (select doc_id, n_chars as n from documents)""",
)
def scaled_and_clipped(spark, sf):
    n = F.col("n_chars")
    some = F.when(F.col("doc_id") % 5 > 0, cubic_centimetres(n))
    return table(spark, sf, "documents").select(
        "doc_id",
        F.round(megabytes(n), 6).alias("mb"),
        F.round(cubic_centimetres(n), 6).alias("cm3"),
        clip_upper(some, 3.0).alias("clipped"),
    )


@register(
    "B17",
    sql=f"""select i.doc_id, i.dataset, round(log10(n), 6) as log_count from ({IMAGE_SQL}) i
            join (select dataset, count(distinct sub) as n from ({IMAGE_SQL}) group by 1) using (dataset)""",
)
def dataset_log_counts(spark, sf):
    rows = with_log_count(images(spark, sf).select("doc_id", "dataset", "sub"), "dataset", "sub")
    return rows.select("doc_id", "dataset", F.round("log_count", 6).alias("log_count"))


@register(
    "B29",
    sql="""select vec_id, cast(list_sum(list_transform(embedding, lambda v: case when v > 0 then 1 else 0 end)) as bigint) as n_inside,
             embedding[1] > 0 as first_inside from embeddings""",
)
def label_masks(spark, sf):
    mask = label_mask(F.col("embedding"))
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.aggregate(mask, F.lit(0).cast("long"), lambda a, v: a + v).alias("n_inside"),
        (F.get(mask, F.lit(0)) == 1).alias("first_inside"),
    )


@register(
    "B30",
    sql="""select vec_id, label, case when label < 6 then label * 20
             else 50 + cast(concat('0x', substr(md5(cast(label as varchar)), 1, 8)) as bigint) % 205 end as red from embeddings""",
)
def label_colors(spark, sf):
    """Known labels get their table value, unknown ones a reproducible default."""
    known = table(spark, sf, "embeddings").select("label").distinct().filter("label < 6")
    known = known.select("label", (F.col("label") * 20).alias("red"))
    rows = table(spark, sf, "embeddings").select("vec_id", "label")
    return lookup_or_hash(rows, known, "label", "red")


@register(
    "C6",
    sql=f"""select doc_id, age, sex from ({JOINED_SQL}) where age is not null and nullif(sex, 1) is not null""",
)
def complete_rows(spark, sf):
    joined = images(spark, sf).join(participants(spark, sf), "doc_id", "left")
    blanked = joined.withColumn("sex", F.nullif("sex", F.lit(1)))
    return blanked.dropna(subset=["age", "sex"]).select("doc_id", "age", "sex")
