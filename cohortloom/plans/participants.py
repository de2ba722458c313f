"""Participant tables with differing headers, harmonized in one job."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.config import (
    AGE_COLUMN_BY_DATASET,
    AGE_UNIT_BY_DATASET,
    LARGE_AGE,
    LONGITUDINAL_DATASET,
    WAVE_AGE_COLUMNS,
)
from cohortloom.functions.missing import token_to_null
from cohortloom.functions.people import (
    age_header,
    age_in_years,
    age_unit,
    header_for,
    header_index,
    normalize_age,
    normalize_sex,
    null_if_nonpositive,
    strip_prefix,
)
from cohortloom.operators.aggregates import conflict_range, range_alerts
from cohortloom.operators.dedup import dedup_first
from cohortloom.operators.joins import attach_group, exclude
from cohortloom.operators.quality import key_violations
from cohortloom.operators.reshape import union_all
from cohortloom.sources.tables import read_participants_raw, read_sidecars, sidecar_entry

Loader = Callable[[DataFrame], "Loaded"]

OUTPUT = ("dataset", "sub", "ses", "sex", "age", "file", "block", "line")


@dataclass(frozen=True)
class Loaded:
    """Harmonized rows, plus the rejected datasets with a reason."""

    rows: DataFrame
    rejects: DataFrame


def _field(name: Column) -> Column:
    return token_to_null(F.get("fields", header_index(F.col("header"), name)))


def with_columns_resolved(
    raw: DataFrame, age_columns: Mapping[str, str] = AGE_COLUMN_BY_DATASET
) -> DataFrame:
    """The header chosen for each role, and why a dataset cannot be used."""
    header, dataset = F.col("header"), F.col("dataset")
    age = age_header(dataset, header, age_columns)
    return raw.withColumns(
        {
            "ses_column": header_for(header, ["session", "session_id"]),
            "sex_column": header_for(header, ["sex", "gender"]),
            "age_column": age,
            "reject_reason": F.when(
                ~F.array_contains(header, "participant_id"), F.lit("no participant_id column")
            ).when(
                age.isNotNull() & ~F.coalesce(F.array_contains(header, age), F.lit(False)),
                F.concat(F.lit("no column "), age),
            ),
        }
    )


def _rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNotNull()).select("dataset", "reject_reason").distinct()


def load_default(
    raw: DataFrame,
    sidecars: DataFrame | None = None,
    age_columns: Mapping[str, str] = AGE_COLUMN_BY_DATASET,
    age_units: Mapping[str, str] = AGE_UNIT_BY_DATASET,
) -> Loaded:
    """Every dataset without a loader of its own; ages in years, before deduplication."""
    resolved = with_columns_resolved(raw, age_columns)
    good = resolved.filter(F.col("reject_reason").isNull())
    if sidecars is not None:
        good = attach_group(good, sidecars, ["dataset"])
        description = sidecar_entry(F.col("descriptions"), F.lower("age_column"))
    else:
        description = F.lit(None).cast("string")
    unit = age_unit(F.col("dataset"), description, age_units)
    age = normalize_age(_field(F.col("age_column")))
    rows = good.select(
        "dataset",
        strip_prefix(_field(F.lit("participant_id")), "sub-").alias("sub"),
        strip_prefix(_field(F.col("ses_column")), "ses-").alias("ses"),
        normalize_sex(_field(F.col("sex_column"))).alias("sex"),
        null_if_nonpositive(age_in_years(age, unit)).alias("age"),
        "file",
        "block",
        "line",
    )
    return Loaded(rows.filter(F.col("sub").isNotNull()), _rejected(resolved))


def load_longitudinal(raw: DataFrame, waves: Mapping[str, str] = WAVE_AGE_COLUMNS) -> Loaded:
    """Datasets with one age column per wave: one row per subject and wave that has an age.

    A dataset that lacks a column, or repeats a subject, is rejected.
    """
    needed = ["participant_id", "Sex", *waves.values()]
    lacking = F.array_except(F.array(*map(F.lit, needed)), "header")
    judged = raw.withColumn(
        "reject_reason",
        F.when(F.size(lacking) > 0, F.concat(F.lit("no column "), F.array_join(lacking, ", "))),
    )
    repeated = key_violations(
        judged.filter("reject_reason is null").select(
            "dataset", _field(F.lit("participant_id")).alias("sub")
        ),
        ["dataset", "sub"],
    ).select("dataset", F.lit("subject repeats").alias("_repeat"))
    judged = attach_group(judged, repeated.distinct(), ["dataset"])
    judged = judged.withColumn("reject_reason", F.coalesce("reject_reason", "_repeat"))
    ages = F.array(
        *[
            F.struct(F.lit(w).alias("ses"), normalize_age(_field(F.lit(c))).alias("age"))
            for w, c in waves.items()
        ]
    )
    rows = judged.filter("reject_reason is null").select(
        "dataset",
        strip_prefix(_field(F.lit("participant_id")), "sub-").alias("sub"),
        normalize_sex(_field(F.lit("Sex"))).alias("sex"),
        F.explode(ages).alias("_wave"),
        "file",
        "block",
        "line",
    )
    rows = rows.withColumns({"ses": F.col("_wave.ses"), "age": F.col("_wave.age")})
    return Loaded(rows.filter(F.col("age").isNotNull()).select(*OUTPUT), _rejected(judged))


LOADERS: dict[str, Loader] = {LONGITUDINAL_DATASET: load_longitudinal}


@dataclass(frozen=True)
class Participants:
    """The harmonized table, rejected datasets, age alerts and conflicting ages."""

    table: DataFrame
    rejects: DataFrame
    large_ages: DataFrame
    conflicts: DataFrame


def harmonize(
    raw: DataFrame,
    sidecars: DataFrame | None = None,
    exclusions: DataFrame | None = None,
    loaders: Mapping[str, Loader] = LOADERS,
    **options,
) -> Participants:
    """Harmonize raw rows: registered loaders for their dataset, the default for all others.

    All default datasets are one job.  Duplicates keep the first row in file order.
    """
    if exclusions is not None:
        raw = exclude(raw, exclusions, ["dataset"])
    special = list(loaders)
    default = load_default(raw.filter(~F.col("dataset").isin(special)), sidecars, **options)
    own = [load(raw.filter(F.col("dataset") == d)) for d, load in loaders.items()]
    first = dedup_first(default.rows, ["dataset", "sub", "ses"], ["file", "block", "line"])
    table = union_all([first, *[o.rows for o in own]]).select(*OUTPUT)
    conflicts = conflict_range(default.rows, ["dataset", "sub", "ses"], "age")
    return Participants(
        table,
        union_all([default.rejects, *[o.rejects for o in own]]),
        range_alerts(default.rows, "dataset", "age", LARGE_AGE),
        conflicts.filter("range > 0"),
    )


def harmonize_files(
    spark: SparkSession,
    tables: str | Sequence[str],
    sidecars: str | Sequence[str] | None = None,
    exclusions: DataFrame | None = None,
    loaders: Mapping[str, Loader] = LOADERS,
) -> Participants:
    """:func:`harmonize` on files ``<dataset>/participants.tsv`` and ``<dataset>/participants.json``."""
    described = read_sidecars(spark, sidecars) if sidecars else None
    return harmonize(read_participants_raw(spark, tables), described, exclusions, loaders)


def first_session(table: DataFrame) -> DataFrame:
    """One row per (dataset, sub): the first in file order, for a later session within the row."""
    first = dedup_first(table, ["dataset", "sub"], ["file", "block", "line", "ses"])
    return first.drop("ses", "file", "block", "line")
