"""Regional volumes to a subject-grouped ridge baseline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.config import (
    QC_FILE_SUFFIX,
    REFERENCE_REGION,
    RIDGE_ALPHAS,
    RIDGE_FOLDS,
    VOLUME_FILE_SUFFIX,
    VOLUME_NAME_PATTERN,
    WAVE_AGE_COLUMNS,
)
from cohortloom.functions.names import capture, scan_identifier, swap_suffix
from cohortloom.functions.scalars import feature_label, volume_column
from cohortloom.operators.aggregates import error_moments, merged_moments, metrics_of, qc_summary
from cohortloom.operators.filters import complete_categories, qc_gate, require_category
from cohortloom.operators.joins import keyed_join, lookup
from cohortloom.operators.quality import assert_unique
from cohortloom.operators.reshape import assemble, normalize_by_reference, wide_to_long
from cohortloom.operators.ridge import NestedFit, coefficients, nested_cv, predict_oof
from cohortloom.session import materialize


def wave_ages(participants: DataFrame, waves: dict[str, str] = WAVE_AGE_COLUMNS) -> DataFrame:
    """(participant_id, wave, age) from one age column per wave."""
    ages = participants.select("participant_id", *[F.col(c).try_cast("double").alias(c) for c in waves.values()])
    return wide_to_long(ages, ["participant_id"], waves, "wave", "age")


def load_scans(
    volumes: DataFrame,
    ages: DataFrame,
    qc: DataFrame | None = None,
    min_qc: float | None = None,
    null_qc_passes: bool = True,
) -> DataFrame:
    """Long usable volumes: ``pat_id, participant_id, wave, scan, age, qc_min, qc_mean, region, volume_mm3``.

    ``volumes`` holds ``path, name, region, volume_mm3`` and ``qc`` holds ``path, qc_score``.  Scans
    without an age, below the QC gate or without the reference region are dropped; then regions
    that are not complete over the remaining scans.
    """
    named = capture(volumes, "name", VOLUME_NAME_PATTERN, ["participant_id", "wave", "scan"])
    named = named.filter(F.col("participant_id").isNotNull())
    named = lookup(named, ages, ["participant_id", "wave"], "age")
    if qc is not None:
        sibling = swap_suffix(F.col("path"), VOLUME_FILE_SUFFIX, QC_FILE_SUFFIX)
        scores = qc_summary(qc, ["path"], "qc_score").withColumnRenamed("path", "_qc_path")
        named = keyed_join(named.withColumn("_qc_path", sibling), scores, ["_qc_path"], "left")
        named = named.drop("_qc_path").filter(qc_gate(F.col("qc_min"), min_qc, null_qc_passes))
    else:
        null = F.lit(None).cast("double")
        named = named.withColumns({"qc_min": null, "qc_mean": null})
    pat_id = scan_identifier(F.col("participant_id"), F.col("wave"), F.col("scan"))
    # several checks start from these rows: read the many small files once
    named = materialize(named.withColumn("pat_id", pat_id), "volumes")
    named = require_category(named, ["path"], "region", REFERENCE_REGION)
    return complete_categories(assert_unique(named, ["pat_id", "region"]), "pat_id", "region", "volume_mm3")


SCAN_COLUMNS = ("pat_id", "participant_id", "wave", "scan", "age", "qc_min", "qc_mean")


def long_features(scans: DataFrame, feature_set: str = "icv-normalized") -> DataFrame:
    """Feature label and value per scan and region: shares of the reference, or raw volumes."""
    if feature_set == "icv-normalized":
        scans = normalize_by_reference(
            scans, ["pat_id"], "region", "volume_mm3", REFERENCE_REGION, "value"
        )
    else:
        scans = scans.withColumn("value", F.col("volume_mm3"))
    return scans.withColumn("feature", feature_label(volume_column(F.col("region")), feature_set))


def feature_rows(scans: DataFrame, feature_set: str = "icv-normalized") -> DataFrame:
    """One row per scan with its features as an array in name order."""
    return assemble(long_features(scans, feature_set), SCAN_COLUMNS, "feature", "value")


@dataclass(frozen=True)
class RidgeBaseline:
    fit: NestedFit
    predictions: DataFrame
    coefficients: DataFrame
    report: DataFrame


def ridge_baseline(
    rows: DataFrame,
    names: Sequence[str],
    group: str = "participant_id",
    order: Sequence[str] = ("pat_id",),
    y: str = "age",
    by: str = "wave",
    k: int = RIDGE_FOLDS,
    alphas: Sequence[float] = RIDGE_ALPHAS,
    settings: dict[str, str] | None = None,
) -> RidgeBaseline:
    """Nested selection, out-of-fold predictions, final coefficients and the nested report."""
    fit = nested_cv(rows, group, order, "features", y, k, alphas)
    predictions = predict_oof(fit, "features", y)
    table = coefficients(rows.sparkSession, fit.final, names)
    return RidgeBaseline(
        fit, predictions, table, report(fit, predictions, group, y, by, alphas, settings or {})
    )


def _one(df: DataFrame) -> Column:
    return df.select(F.struct("*")).scalar()


def report(
    fit: NestedFit,
    predictions: DataFrame,
    group: str,
    y: str,
    by: str,
    alphas: Sequence[float],
    settings: dict[str, str],
) -> DataFrame:
    """One nested row: settings, data, CV metrics, baseline, metrics by wave and per fold.

    The predictions are evaluated once.
    """
    # one scan: everything below is rolled up from a stored row for each subject, wave and fold
    keys = [F.col(group).alias("_group"), F.col(by).alias("wave"), "fold", "alpha"]
    plain = predictions.select(*keys, F.col(y).cast("double").alias("_y"), "prediction")
    fine = materialize(error_moments(plain, "_y", "prediction", ["_group", "wave", "fold", "alpha"], fit.mean), "moments")
    groups = fine.agg(F.count_distinct("_group")).scalar()
    cells = materialize(merged_moments(fine, ["wave", "fold", "alpha"]), "cells")
    whole = merged_moments(cells)
    data = whole.select(
        F.col("n_y").alias("n_scans"),
        groups.alias("n_subjects"),
        F.col("y_min").alias("age_min"),
        F.col("y_max").alias("age_max"),
        F.lit(fit.mean).alias("age_mean"),
    )
    waves = metrics_of(merged_moments(cells, ["wave"]), ["wave"])
    folds = merged_moments(cells, ["fold", "alpha"])
    folds = folds.select("fold", "alpha", (F.col("e_abs") / F.col("n")).alias("mae"))
    # predicting the mean: no spread of the predictions, no explained variance, no bias
    baseline = whole.select(
        (F.col("c_abs") / F.col("n_y")).alias("mae"),
        F.sqrt(F.col("c_sq") / F.col("n_y")).alias("rmse"),
        (1 - F.try_divide(F.col("c_sq"), F.col("yy"))).alias("r2"),
        F.lit(None).cast("double").alias("pearson_r"),
        F.lit(0.0).alias("bias"),
        F.col("n_y").alias("n"),
    )
    collected = {
        "by_wave": waves.agg(F.array_sort(F.collect_list(F.struct("*")))).scalar(),
        "per_fold": folds.agg(F.array_sort(F.collect_list(F.struct("*")))).scalar(),
    }
    stated = F.struct(
        *[F.lit(v).alias(n) for n, v in settings.items()],
        F.lit(len(fit.folds)).alias("folds"),
        F.array(*map(F.lit, map(float, alphas))).alias("alphas"),
    )
    described = data.withColumn("n_features", F.lit(len(fit.final.coef)))
    return described.select(
        stated.alias("settings"),
        F.struct("*").alias("data"),
        _one(metrics_of(whole)).alias("group_cv"),
        _one(baseline).alias("mean_age_baseline"),
        *[c.alias(n) for n, c in collected.items()],
        F.lit(fit.final.alpha).alias("final_refit_alpha"),
    )
