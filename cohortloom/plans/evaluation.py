"""Labels for an evaluation subset, and the evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.config import SCAN_NAME_PATTERN, SKIP_REASONS, WAVE_AGE_COLUMNS
from cohortloom.functions.missing import token_to_null
from cohortloom.functions.names import capture, image_stem
from cohortloom.functions.scalars import months_to_years, pick_by, with_errors, years_to_months
from cohortloom.operators.aggregates import metric_columns
from cohortloom.operators.joins import attach_predictions, lookup_with_reasons


def age_labels(
    images: DataFrame,
    participants: DataFrame,
    units: str = "months",
    pattern: str = SCAN_NAME_PATTERN,
    waves: dict[str, str] = WAVE_AGE_COLUMNS,
) -> tuple[DataFrame, DataFrame]:
    """``(pat_id, label)`` of the images that have an age, and ``(pat_id, reason)`` of the others."""
    named = images.select(image_stem(F.col("path")).alias("pat_id"))
    named = capture(named, "pat_id", pattern, ["participant_id", "wave"])
    text = {w: token_to_null(F.col(c).cast("string")) for w, c in waves.items()}
    ages = {w: F.when(F.lower(c) != "n/a", c) for w, c in text.items()}
    age = pick_by(F.col("wave"), ages)
    column = pick_by(F.col("wave"), {w: F.lit(c) for w, c in waves.items()})
    judged = lookup_with_reasons(
        named,
        participants.select("participant_id", *waves.values()),
        ["participant_id"],
        age,
        F.col("participant_id").isNotNull(),
        (
            F.lit(SKIP_REASONS[0]),
            F.format_string(SKIP_REASONS[1], "participant_id"),
            F.format_string(SKIP_REASONS[2], column),
        ),
    )
    years = age.cast("double")
    label = years_to_months(years) if units == "months" else years
    good = judged.filter("reason is null").select("pat_id", label.alias("label"))
    return good, judged.filter("reason is not null").select("pat_id", "reason")


def evaluate(
    labels: DataFrame, predictions: DataFrame, key: str = "pat_id", settings: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Labels with predictions and errors (in months), and one row of metrics."""
    joined = attach_predictions(labels, predictions, key)
    rows = with_errors(joined, "label", "predicted_value")
    m = metric_columns(F.col("label").cast("double"), F.col("predicted_value").cast("double"))
    metrics = rows.agg(
        F.current_timestamp().alias("timestamp"),
        m["n"].alias("n"),
        *[F.lit(v).alias(k) for k, v in (settings or {}).items()],
        m["mae"].alias("mae_months"),
        months_to_years(m["mae"]).alias("mae_years"),
        m["rmse"].alias("rmse_months"),
        months_to_years(m["rmse"]).alias("rmse_years"),
        m["r2"].alias("r2"),
        F.avg("predicted_value").alias("mean_prediction_months"),
        F.avg("label").alias("mean_label_months"),
    )
    return rows, metrics
