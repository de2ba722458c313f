"""Counts, quantiles, histograms and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.catalog.base import IMAGE_SQL, images, register, table
from cohortloom.operators.aggregates import (
    baseline_metrics,
    box_stats,
    distinct_counts,
    distinct_keys,
    duplicate_summary,
    fold_metrics,
    histogram,
    median_by,
    non_null_counts,
    qc_summary,
    quantile_profile,
    range_alerts,
    regression_metrics,
    score_means,
    summary,
    value_counts,
)
from cohortloom.operators.ordering import top_abs, top_k
from cohortloom.operators.positions import curve, ecdf, rank_error
from cohortloom.operators.reshape import unpivot_scores


def _rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@register(
    "E1",
    sql="""select suffix, count(*) as count from (select nullif(lang, 'en') as suffix from documents) where suffix is not null
           group by 1 order by 2 desc, 1 limit 2""",
)
def top_values(spark, sf):
    rows = table(spark, sf, "documents").select(F.nullif("lang", F.lit("en")).alias("suffix"))
    return value_counts(rows, "suffix", 2)


@register("E1", sql="select event_type, count(*) as count from events group by 1")
def all_values(spark, sf):
    return value_counts(table(spark, sf, "events"), "event_type")


@register(
    "E2",
    sql=f"""select count(*) as n_groups, cast(coalesce(sum(n), 0) as bigint) as n_rows
            from (select md5, count(*) as n from ({IMAGE_SQL}) group by 1 having count(*) > 1)""",
)
def duplicate_groups(spark, sf):
    return duplicate_summary(images(spark, sf), "md5")


@register(
    "E4",
    sql=f"""select dataset, count(distinct sub) as n_subs, count(distinct suffix) as n_suffixes from ({IMAGE_SQL}) group by 1""",
)
def distinct_per_dataset(spark, sf):
    return distinct_counts(images(spark, sf), {"n_subs": "sub", "n_suffixes": "suffix"}, ["dataset"])


@register(
    "E5",
    sql="""select count(*) as n from (select distinct nullif(user_id, 3) as a, event_type from events) where a is not null""",
)
def distinct_pairs(spark, sf):
    rows = table(spark, sf, "events").withColumn("a", F.nullif("user_id", F.lit(3)))
    return distinct_keys(rows, ["a", "event_type"])


@register("E6", sql="select user_id, round(median(value), 6) as median from events group by 1")
def median_per_user(spark, sf):
    return _rounded(median_by(table(spark, sf, "events"), ["user_id"], "value"), 6, "median")


@register(
    "E7",
    sql="""select round(quantile_cont(v, 0.01), 6) as p01, round(quantile_cont(v, 0.05), 6) as p05,
             round(quantile_cont(v, 0.5), 6) as median, round(quantile_cont(v, 0.95), 6) as p95, round(max(v), 6) as max
           from (select l_extendedprice / 1000 as v from lineitem)""",
)
def price_profile(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 1000).alias("v"))
    return _rounded(quantile_profile(rows, "v"), 6, "p01", "p05", "median", "p95", "max")


@register(
    "E9",
    sql="""select count(*) as n_event_id, count(nullif(user_id, 3)) as n_user_id, count(nullif(event_type, 'click')) as n_event_type
           from events""",
)
def non_null_columns(spark, sf):
    rows = table(spark, sf, "events").withColumns(
        {"user_id": F.nullif("user_id", F.lit(3)), "event_type": F.nullif("event_type", F.lit("click"))}
    )
    return non_null_counts(rows, ["event_id", "user_id", "event_type"])


@register(
    "E10",
    sql="""select l_orderkey, min(nullif(l_discount, 0)) as qc_min, round(avg(nullif(l_discount, 0)), 6) as qc_mean
           from lineitem group by 1""",
)
def qc_per_scan(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("score", F.nullif("l_discount", F.lit(0.0)))
    return _rounded(qc_summary(rows, ["l_orderkey"], "score"), 6, "qc_mean")


@register(
    "E11",
    "H4",
    sql="""select score, round(avg(value), 6) as mean from (
             select 'l_discount' as score, l_discount as value from lineitem
             union all select 'l_quantity', l_quantity from lineitem
             union all select 'l_tax', l_tax from lineitem) group by 1""",
)
def mean_scores(spark, sf):
    wide = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax")
    return _rounded(score_means(unpivot_scores(wide, "l_orderkey"), ["score"], "value"), 6, "mean")


_METRICS_SQL = """round(avg(abs(p - y)), 4) as mae, round(sqrt(avg((p - y) * (p - y))), 4) as rmse,
  round(1 - sum((p - y) * (p - y)) / nullif(var_pop(y) * count(*), 0), 6) as r2, round(corr(y, p), 6) as pearson_r,
  round(avg(p - y), 4) as bias, count(*) as n"""
_PRICED_SQL = "select l_returnflag, l_suppkey % 5 as fold, l_extendedprice as y, l_quantity * 1500 + l_tax * 100 as p from lineitem"


def _priced(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_returnflag",
        (F.col("l_suppkey") % 5).alias("fold"),
        F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * 1500 + F.col("l_tax") * 100).alias("p"),
    )


def _round_metrics(df):
    digits = {"mae": 4, "rmse": 4, "r2": 6, "pearson_r": 6, "bias": 4}
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


@register("E12", sql=f"select {_METRICS_SQL} from ({_PRICED_SQL})")
def metrics_overall(spark, sf):
    return _round_metrics(regression_metrics(_priced(spark, sf), "y", "p"))


@register("E12", sql=f"select l_returnflag, {_METRICS_SQL} from ({_PRICED_SQL}) group by 1")
def metrics_by_group(spark, sf):
    return _round_metrics(regression_metrics(_priced(spark, sf), "y", "p", ["l_returnflag"]))


@register(
    "E13",
    sql="""select round(avg(abs(m - y)), 4) as mae, round(sqrt(avg((m - y) * (m - y))), 4) as rmse, round(0.0::double, 6) as r2,
             cast(null as double) as pearson_r, 0.0::double as bias, count(*) as n
           from (select l_extendedprice as y, avg(l_extendedprice) over () as m from lineitem)""",
)
def metrics_of_mean(spark, sf):
    out = _round_metrics(baseline_metrics(_priced(spark, sf), "y"))
    # a sum of rounding errors may come out as -0.0
    return out.withColumns({"r2": F.abs("r2"), "bias": F.abs("bias")})


@register(
    "E14",
    sql=f"select fold, cast(max(fold) as double) as alpha, round(avg(abs(p - y)), 4) as mae from ({_PRICED_SQL}) group by 1",
)
def metrics_by_fold(spark, sf):
    rows = _priced(spark, sf).withColumn("alpha", F.col("fold").cast("double"))
    return _rounded(fold_metrics(rows, "y", "p", "fold", "alpha"), 4, "mae")


@register(
    "E15",
    sql=f"""select count(*) as n, min(y) as y_min, max(y) as y_max, round(avg(y), 4) as y_mean,
              round(min(p), 6) as p_min, round(max(p), 6) as p_max, round(avg(p), 4) as p_mean from ({_PRICED_SQL})""",
)
def label_summary(spark, sf):
    out = summary(_priced(spark, sf), ["y", "p"])
    return _rounded(_rounded(out, 4, "y_mean", "p_mean"), 6, "p_min", "p_max")


@register(
    "E17",
    sql="select user_id, max(value) as largest from events group by 1 having max(value) > 200",
)
def large_values(spark, sf):
    return range_alerts(table(spark, sf, "events"), "user_id", "value", 200)


def _histogram_sql(source, bins, by=""):
    keys = f"{by}, " if by else ""
    using = f"using ({by})" if by else "on true"
    return f"""
      with d as ({source}),
      s as (select {keys}min(v) as lo, max(v) as hi from d {f"group by {by}" if by else ""}),
      b as (select {keys}cast(least(floor((v - lo) / ((hi - lo) / {bins})) + 1, {bins}) as int) as bin, count(*) as n
            from d join s {using} group by all),
      g as (select {keys}lo, hi, cast(range as int) as bin from s, range(1, {bins} + 1))
      select {"g." + keys if by else ""}g.bin, round(lo + (hi - lo) / {bins} * (g.bin - 1), 6) as low,
             round(lo + (hi - lo) / {bins} * g.bin, 6) as high, coalesce(n, 0) as count
      from g left join b using ({keys}bin)"""


@register(
    "E19",
    sql=_histogram_sql("select least(value, 100.0) as v from events", 20),
)
def clipped_histogram(spark, sf):
    out = histogram(table(spark, sf, "events"), "value", 20, clip=100.0)
    return _rounded(out, 6, "low", "high")


@register(
    "E19",
    sql=_histogram_sql("select event_type, value as v from events", 40, "event_type"),
)
def grouped_histogram(spark, sf):
    out = histogram(table(spark, sf, "events"), "value", 40, ["event_type"])
    return _rounded(out, 6, "low", "high")


@register(
    "E20",
    sql="""
      with q as (select event_type, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median,
                        quantile_cont(value, 0.75) as q3, count(*) as n_values from events group by 1),
      j as (select e.value, q.*, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from events e join q using (event_type))
      select event_type, round(any_value(q1), 6) as q1, round(any_value(median), 6) as median, round(any_value(q3), 6) as q3,
             any_value(n_values) as n_values, min(value) filter (where value between lo and hi) as whisker_low,
             max(value) filter (where value between lo and hi) as whisker_high,
             count(*) filter (where not (value between lo and hi)) as n_outliers
      from j group by 1""",
)
def box_statistics(spark, sf):
    return _rounded(box_stats(table(spark, sf, "events"), "event_type", "value"), 6, "q1", "median", "q3")


@register(
    "F4",
    sql="""select distinct event_type, value, round(cume_dist() over (partition by event_type order by value), 6) as fraction
           from events""",
)
def value_curves(spark, sf):
    return _rounded(ecdf(table(spark, sf, "events"), "value", ["event_type"]), 6, "fraction")


@register(
    "F4",
    sql="""select event_type, i / 20.0::double as fraction, true as within, min(value) as low, max(value) as high
           from events, (select unnest(range(21)) as i) group by 1, 2""",
)
def value_curves_at_points(spark, sf):
    """Curves at 21 fractions from sketches; every rank is held against the exact ranks of the values."""
    events = table(spark, sf, "events")
    sketched = curve(events, "value", ["event_type"], 21)
    # exact ranks of the reported values: rows below and rows not above
    counts = events.groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n"))
    met = sketched.withColumnRenamed("value", "at").join(counts, "event_type")
    ranked = met.groupBy("event_type", "fraction", "at").agg(
        F.sum(F.when(F.col("value") < F.col("at"), F.col("n")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("value") <= F.col("at"), F.col("n")).otherwise(0)).alias("upto"),
        F.sum("n").alias("all"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )
    off = F.greatest(F.col("below") / F.col("all") - F.col("fraction"), F.col("fraction") - F.col("upto") / F.col("all"))
    return ranked.select("event_type", "fraction", (off <= rank_error()).alias("within"), "low", "high")


@register(
    "G2",
    sql="""select doc_id, n_chars from documents where n_chars < 3000 order by n_chars, doc_id limit 10""",
)
def smallest_files(spark, sf):
    small = table(spark, sf, "documents").filter("n_chars < 3000")
    return top_k(small, "n_chars", 10, ["doc_id"]).select("doc_id", "n_chars")


@register(
    "G2",
    sql="""select doc_id, n_chars from documents where n_chars > 5000 order by n_chars desc, doc_id limit 10""",
)
def biggest_files(spark, sf):
    big = table(spark, sf, "documents").filter("n_chars > 5000")
    return top_k(big, "n_chars", 10, ["doc_id"], True).select("doc_id", "n_chars")


@register(
    "G5",
    sql="""select event_id, round(value - 60, 6) as residual from events order by abs(round(value - 60, 6)) desc, event_id limit 15""",
)
def largest_magnitudes(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.round(F.col("value") - 60, 6).alias("residual"))
    return top_abs(rows, "residual", ["event_id"], 15)
