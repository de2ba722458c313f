"""Scaling, ridge regression, nested selection and scoring on line items."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cohortloom.catalog.base import FOLDS_SQL, VOLUME_SQL, register, table, volumes
from cohortloom.operators.aggregates import regression_metrics
from cohortloom.operators.reshape import array_of, assemble
from cohortloom.operators.ridge import (
    Moments,
    coefficients,
    feature_means,
    fit_scaler,
    gram_sums,
    nested_cv,
    predict_oof,
    ridge_path,
    scale,
)
from cohortloom.operators.scoring import score
from cohortloom.operators.tsqr import nested_qr
from cohortloom.plans.evaluation import evaluate
from cohortloom.plans.regional import ridge_baseline

FEATURES = ["l_quantity", "l_discount", "l_tax"]
ROW_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *FEATURES, "l_extendedprice"]
ALPHAS = (0.1, 10.0, 1000.0)


def model_rows(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rows.select(*ROW_ORDER, "l_returnflag", array_of(FEATURES))


@register(
    "I1",
    sql=f"""select scan, cast(count(*) as int) as n_features, arg_min(volume, region) as first_value, arg_max(volume, region) as last_value
            from ({VOLUME_SQL}) group by 1""",
)
def assembled_features(spark, sf):
    rows = assemble(volumes(spark, sf), ["scan"], "region", "volume")
    return rows.select(
        "scan",
        F.size("features").alias("n_features"),
        F.get("features", F.lit(0)).alias("first_value"),
        F.element_at("features", -1).alias("last_value"),
    )


_LONG_SQL = """select l_orderkey, l_partkey, f.score, f.value from lineitem,
  lateral (select unnest(['l_quantity', 'l_discount', 'l_tax']) as score, unnest([l_quantity, l_discount, l_tax]) as value) f"""


@register(
    "I2",
    sql=f"""select l_orderkey, l_partkey, score, round((value - m) / s, 6) as z from ({_LONG_SQL})
            join (select score, avg(value) as m, stddev_pop(value) as s from ({_LONG_SQL}) group by 1) using (score)""",
)
def standardized_values(spark, sf):
    wide = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", *FEATURES)
    long = wide.unpivot(["l_orderkey", "l_partkey"], FEATURES, "score", "value")
    scaled = scale(long, fit_scaler(long, "score", "value"), "score", "value")
    return scaled.select("l_orderkey", "l_partkey", "score", F.round("z", 6).alias("z"))


@register(
    "I3",
    sql="""
      with s as (select count(*) as n, stddev_pop(l_quantity) as sd, covar_pop(l_quantity, l_extendedprice) as c,
                        avg(l_quantity) as mx, avg(l_extendedprice) as my from lineitem)
      select alpha, round(n * c / sd / (n + alpha), 3) as standardized, round(my - mx * (n * c / sd / (n + alpha) / sd), 2) as intercept
      from s, (select unnest([0.1::double, 10.0, 1000.0]) as alpha)""",
)
def ridge_over_penalties(spark, sf):
    """One feature, all penalties: the closed form is the SQL."""
    rows = table(spark, sf, "lineitem").select(
        array_of(["l_quantity"]), "l_extendedprice", F.lit("all").alias("cell")
    )
    shift = feature_means(rows, "features", "l_extendedprice")
    gram = np.asarray(gram_sums(rows, "features", "l_extendedprice", "cell", shift).first()["gram"])
    gram = gram.reshape(3, 3)
    std = Moments.of(gram).deviation()
    out = []
    for alpha, beta in zip(ALPHAS, ridge_path(gram, std, ALPHAS)):
        intercept = beta[0] + shift[1] - beta[1] * shift[0]
        out.append((float(alpha), round(float(beta[1] * std[0]), 3), round(float(intercept), 2)))
    return spark.createDataFrame(out, "alpha double, standardized double, intercept double")


def _fit(spark, sf):
    rows = model_rows(spark, sf)
    return nested_cv(rows, "l_suppkey", ROW_ORDER, "features", "l_extendedprice", 5, ALPHAS)


def _det(m: list[list[str]]) -> str:
    """Determinant of a 3 x 3 matrix of SQL expressions."""
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_R = range(3)
_IJ = [(i, j) for i in _R for j in _R if i <= j]


def _v(i: int, j: int, prefix: str = "v") -> str:
    return f"{prefix}{min(i, j)}{max(i, j)}"


def _cramer() -> str:
    """``w0, w1, w2``: the solution of (v + alpha) w = c."""
    m = [[f"({_v(i, j)} + alpha)" if i == j else _v(i, j) for j in _R] for i in _R]
    whole = _det(m)
    return ", ".join(f"{_det([[f'c{i}' if j == k else m[i][j] for j in _R] for i in _R])} / {whole} as w{k}" for k in _R)


def _normal(n: str, sums: str) -> str:
    """Centred and scaled sums ``c*, v*`` and means ``u*, uy`` from sums, written ``sums.format(name)``."""
    at = sums.format
    parts = [f"({at(f'sxy{i}')} - {at(f'sx{i}')} * {at('sy')} / {n}) / sd{i} as c{i}" for i in _R]
    parts += [f"({at(f'sxx{i}{j}')} - {at(f'sx{i}')} * {at(f'sx{j}')} / {n}) / (sd{i} * sd{j}) as v{i}{j}" for i, j in _IJ]
    return ", ".join(parts + [f"{at(f'sx{i}')} / {n} as u{i}" for i in _R] + [f"{at('sy')} / {n} as uy"])


_SUMS = [*[f"sx{i}" for i in _R], "sy", *[f"sxx{i}{j}" for i, j in _IJ], *[f"sxy{i}" for i in _R], "syy"]
_SSE = " + ".join(
    ["q.syy + q.n * base * base - 2 * base * q.sy"]
    + [f"{1 if i == j else 2} * b{i} * b{j} * q.sxx{i}{j}" for i, j in _IJ]
    + [f"2 * b{i} * (base * q.sx{i} - q.sxy{i})" for i in _R]
)
# The nested search with three features, every system solved by Cramer's rule. Split 0 uses all rows.
_SEARCH_SQL = f"""
  with recursive {FOLDS_SQL},
  m as (select {", ".join(f"avg({f}) as m{i}" for i, f in enumerate(FEATURES))}, avg(l_extendedprice) as my from lineitem),
  d as (select l.*, gf.fold, {", ".join(f"{f} - m{i} as x{i}" for i, f in enumerate(FEATURES))}, l_extendedprice - my as y
        from lineitem l join gf using (l_suppkey), m),
  t as (select o, d.*, ntile(5) over (partition by o order by {", ".join(ROW_ORDER)}) as piece
        from d join (select unnest([0, 1, 2, 3, 4, 5]) as o) on fold <> o),
  s as (select o, piece, count(*) as n, {", ".join(f"sum(x{i}) as sx{i}" for i in _R)}, sum(y) as sy,
               {", ".join(f"sum(x{i} * x{j}) as sxx{i}{j}" for i, j in _IJ)}, {", ".join(f"sum(x{i} * y) as sxy{i}" for i in _R)},
               sum(y * y) as syy from t group by 1, 2),
  a0 as (select o, sum(n) as n, {", ".join(f"sum({c}) as {c}" for c in _SUMS)} from s group by 1),
  a as (select *, {", ".join(f"sqrt(sxx{i}{i} / n - power(sx{i} / n, 2)) as sd{i}" for i in _R)} from a0),
  p as (select unnest([0.1::double, 10.0, 1000.0]) as alpha),
  f0 as (select s.o, piece, alpha, {", ".join(f"sd{i}" for i in _R)}, {_normal("(a.n - s.n)", "(a.{0} - s.{0})")} from s join a using (o), p),
  f1 as (select *, {_cramer()} from f0),
  f2 as (select *, {", ".join(f"w{i} / sd{i} as b{i}" for i in _R)} from f1),
  f3 as (select *, uy - {" - ".join(f"b{i} * u{i}" for i in _R)} as base from f2),
  r as (select f3.o, alpha, avg(1 - ({_SSE}) / (q.syy - q.sy * q.sy / q.n)) as score from f3 join s q on q.o = f3.o and q.piece = f3.piece group by 1, 2),
  z as (select o, arg_max(alpha, score) as alpha from r group by 1),
  h0 as (select a.o, alpha, {", ".join(f"sd{i}" for i in _R)}, {_normal("a.n", "a.{0}")} from a join z using (o)),
  h as (select *, {_cramer()} from h0)"""
_PREDICTED = "my + uy + " + " + ".join(f"w{i} / sd{i} * (x{i} - u{i})" for i in _R)
_OUT_OF_FOLD_SQL = f"""{_SEARCH_SQL}
  select l_orderkey, l_linenumber, d.fold, alpha, round({_PREDICTED}, 3) as prediction,
         round({_PREDICTED} - l_extendedprice, 3) as residual, round(abs({_PREDICTED} - l_extendedprice), 3) as absolute_error
  from d join h on fold = o, m"""
_FINAL_SQL = f"""{_SEARCH_SQL}
  select unnest(['{FEATURES[0]}', '{FEATURES[1]}', '{FEATURES[2]}']) as feature,
         unnest([round(w0, 3), round(w1, 3), round(w2, 3)]) as standardized_coefficient from h where o = 0"""


def _out_of_fold(fit):
    return predict_oof(fit, "features", "l_extendedprice").select(
        "l_orderkey",
        "l_linenumber",
        "fold",
        "alpha",
        F.round("prediction", 3).alias("prediction"),
        F.round("residual", 3).alias("residual"),
        F.round("absolute_error", 3).alias("absolute_error"),
    )


@register("I4", "I5", sql=_OUT_OF_FOLD_SQL)
def out_of_fold_predictions(spark, sf):
    return _out_of_fold(_fit(spark, sf))


def _factor_fit(spark, sf):
    return nested_qr(model_rows(spark, sf), "l_suppkey", ROW_ORDER, "features", "l_extendedprice", 5, ALPHAS)


@register("I3", "I4", "I5", sql=_OUT_OF_FOLD_SQL)
def out_of_fold_by_factors(spark, sf):
    """The same search on triangular factors."""
    return _out_of_fold(_factor_fit(spark, sf))


def _coefficients(spark, fit):
    out = coefficients(spark, fit.final, FEATURES)
    return out.withColumn("standardized_coefficient", F.round("standardized_coefficient", 3))


@register("I6", sql=_FINAL_SQL)
def final_coefficients(spark, sf):
    return _coefficients(spark, _fit(spark, sf))


@register("I6", sql=_FINAL_SQL)
def final_coefficients_by_factors(spark, sf):
    return _coefficients(spark, _factor_fit(spark, sf))


# The same search for one feature, where every solve is a closed form.  Split 0 uses all rows.
_ONE_FEATURE_SQL = f"""
  with recursive {FOLDS_SQL},
  m as (select avg(l_quantity) as mx, avg(l_extendedprice) as my from lineitem),
  d as (select l.*, gf.fold, l_quantity - mx as x, l_extendedprice - my as y
        from lineitem l join gf using (l_suppkey), m),
  t as (select o, d.*, ntile(5) over (partition by o order by {", ".join(ROW_ORDER)}) as piece
        from d join (select unnest([0, 1, 2, 3, 4, 5]) as o) on fold <> o),
  s as (select o, piece, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy, sum(y * y) as syy
        from t group by 1, 2),
  a as (select o, sum(n) as n, sum(sx) as sx, sum(sy) as sy, sum(sxx) as sxx, sum(sxy) as sxy,
               sqrt(sum(sxx) / sum(n) - power(sum(sx) / sum(n), 2)) as sd from s group by 1),
  p as (select unnest([0.1::double, 10.0, 1000.0]) as alpha),
  f as (select o, piece, alpha, ((a.sxy - s.sxy) - (a.sx - s.sx) * (a.sy - s.sy) / (a.n - s.n)) / sd as c,
               ((a.sxx - s.sxx) - power(a.sx - s.sx, 2) / (a.n - s.n)) / (sd * sd) as v, sd,
               (a.sx - s.sx) / (a.n - s.n) as ux, (a.sy - s.sy) / (a.n - s.n) as uy,
               s.n, s.sx, s.sy, s.sxx, s.sxy, s.syy from s join a using (o), p),
  e as (select *, c / (v + alpha) / sd as slope, uy - c / (v + alpha) / sd * ux as base from f),
  r as (select o, alpha, avg(1 - (syy + n * base * base + slope * slope * sxx - 2 * base * sy - 2 * slope * sxy + 2 * base * slope * sx)
                                 / (syy - sy * sy / n)) as score from e group by 1, 2),
  z as (select o, arg_max(alpha, score) as alpha from r group by 1),
  h as (select o, alpha, sd, (sxy - sx * sy / n) / sd / ((sxx - sx * sx / n) / (sd * sd) + alpha) as std_coef,
               sx / n as ux, sy / n as uy from a join z using (o))"""


def _fit_one(spark, sf):
    rows = table(spark, sf, "lineitem").select(*ROW_ORDER, array_of(["l_quantity"]))
    return nested_cv(rows, "l_suppkey", ROW_ORDER, "features", "l_extendedprice", 5, ALPHAS)


@register(
    "I4",
    "I5",
    sql=f"""{_ONE_FEATURE_SQL}
      select l_orderkey, l_linenumber, l_partkey, fold, alpha, round(my + uy + std_coef / sd * (x - ux), 2) as prediction
      from d join h on fold = o, m""",
)
def out_of_fold_one_feature(spark, sf):
    return predict_oof(_fit_one(spark, sf), "features", "l_extendedprice").select(
        "l_orderkey", "l_linenumber", "l_partkey", "fold", "alpha", F.round("prediction", 2).alias("prediction")
    )


@register(
    "I6",
    sql=f"""{_ONE_FEATURE_SQL} select 'l_quantity' as feature, round(std_coef, 3) as standardized_coefficient, alpha from h where o = 0""",
)
def final_one_feature(spark, sf):
    model = _fit_one(spark, sf).final
    out = coefficients(spark, model, ["l_quantity"]).withColumn("alpha", F.lit(model.alpha))
    return out.withColumn("standardized_coefficient", F.round("standardized_coefficient", 3))


_PAIRS_SQL = f"""{_SEARCH_SQL},
  pairs as (select l_suppkey, l_returnflag, d.fold, alpha, l_extendedprice as y, {_PREDICTED} as p from d join h on fold = o, m),
  c as (select avg(y) as mean from pairs)"""
_METRICS_SQL = """round(avg(abs(p - y)), 4) as mae, round(sqrt(avg((p - y) ** 2)), 4) as rmse,
  round(1 - sum((p - y) ** 2) / (var_pop(y) * count(*)), 6) as r2, round(corr(y, p), 6) as pearson_r, round(avg(p - y), 4) + 0.0 as bias, count(*) as n"""


def _report(spark, sf):
    return ridge_baseline(
        model_rows(spark, sf),
        FEATURES,
        "l_suppkey",
        ROW_ORDER,
        "l_extendedprice",
        "l_returnflag",
        5,
        ALPHAS,
        {"feature_set": "raw"},
    ).report


def _rounded_metrics(of):
    digits = {"mae": 4, "rmse": 4, "r2": 6, "pearson_r": 6, "bias": 4}
    return [(F.round(of(c), d) + F.lit(0.0)).alias(c) for c, d in digits.items()]


@register(
    "I8",
    "A10",
    "E12",
    "E13",
    sql=f"""{_PAIRS_SQL}
      select count(*) as n_scans, count(distinct l_suppkey) as n_subjects, cast(3 as int) as n_features,
             min(y) as age_min, max(y) as age_max, round(avg(y), 4) as age_mean,
             count(distinct l_returnflag) as n_waves, cast(5 as bigint) as n_folds, {_METRICS_SQL},
             round(avg(abs(y - mean)), 4) as baseline_mae, round(sqrt(avg((y - mean) ** 2)), 4) as baseline_rmse,
             (select alpha from h where o = 0) as final_refit_alpha
      from pairs, c""",
)
def selection_report(spark, sf):
    got = _report(spark, sf)
    return got.select(
        "data.n_scans",
        "data.n_subjects",
        "data.n_features",
        "data.age_min",
        "data.age_max",
        F.round("data.age_mean", 4).alias("age_mean"),
        F.size("by_wave").cast("long").alias("n_waves"),
        F.size("per_fold").cast("long").alias("n_folds"),
        *_rounded_metrics(lambda c: F.col(f"group_cv.{c}")),
        F.col("group_cv.n").alias("n"),
        F.round("mean_age_baseline.mae", 4).alias("baseline_mae"),
        F.round("mean_age_baseline.rmse", 4).alias("baseline_rmse"),
        "final_refit_alpha",
    )


@register(
    "I8",
    "E12",
    "E14",
    sql=f"""{_PAIRS_SQL}
      select 'wave ' || l_returnflag as part, cast(null as double) as alpha, {_METRICS_SQL} from pairs group by l_returnflag
      union all
      select 'fold ' || fold, alpha, round(avg(abs(p - y)), 4), null, null, null, null, null from pairs group by fold, alpha""",
)
def selection_report_parts(spark, sf):
    """Metrics by wave, and penalty and error per fold, out of the report."""
    got = _report(spark, sf)
    wave = got.select(F.explode("by_wave").alias("w")).select(
        F.concat(F.lit("wave "), "w.wave").alias("part"), F.lit(None).cast("double").alias("alpha"),
        *_rounded_metrics(lambda c: F.col(f"w.{c}")), F.col("w.n").alias("n"),
    )
    fold = got.select(F.explode("per_fold").alias("f")).select(
        F.concat(F.lit("fold "), F.col("f.fold").cast("string")).alias("part"), "f.alpha", F.round("f.mae", 4).alias("mae")
    )
    return wave.unionByName(fold, allowMissingColumns=True)


def linear_model():
    """A stand-in for a network: built once per worker, called per batch."""
    weights = np.array([1500.0, -200.0, 100.0])

    def predict(batch):
        return batch @ weights + 7.0

    return predict


def _scored(spark, sf):
    return score(model_rows(spark, sf), linear_model, "features", 3)


@register(
    "I7",
    "K5",
    sql="""select l_orderkey, l_linenumber, l_partkey,
             round(1500 * l_quantity - 200 * l_discount + 100 * l_tax + 7, 6) as prediction from lineitem""",
)
def batch_scores(spark, sf):
    return _scored(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round("prediction", 6).alias("prediction")
    )


@register(
    "I7",
    "E12",
    "E15",
    sql="""
      with p as (select o_orderkey, o_totalprice as label, o_totalprice * 0.9 + 100 as predicted from orders)
      select count(*) as n, round(avg(abs(predicted - label)), 4) as mae_months, round(avg(abs(predicted - label)) / 12, 4) as mae_years,
             round(sqrt(avg((predicted - label) ** 2)), 4) as rmse_months, round(1 - sum((predicted - label) ** 2) / (var_pop(label) * count(*)), 6) as r2,
             round(avg(predicted), 4) as mean_prediction_months, round(avg(label), 4) as mean_label_months from p""",
)
def evaluation_metrics(spark, sf):
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey").alias("pat_id")
    labels = orders.select(key, F.col("o_totalprice").alias("label"))
    predicted = orders.select(key, (F.col("o_totalprice") * 0.9 + 100).alias("predicted_value"))
    _, metrics = evaluate(labels, predicted)
    digits = {"r2": 6}
    kept = [c for c in metrics.columns if c not in ("timestamp", "n", "rmse_years")]
    return metrics.select("n", *[F.round(c, digits.get(c, 4)).alias(c) for c in kept])


@register(
    "I5",
    "E12",
    sql="""select l_returnflag, count(*) as n from lineitem group by 1""",
)
def predictions_per_group(spark, sf):
    """One out-of-fold prediction per row, in every group."""
    predictions = predict_oof(_fit(spark, sf), "features", "l_extendedprice")
    return regression_metrics(predictions, "l_extendedprice", "prediction", ["l_returnflag"]).select("l_returnflag", "n")
