"""From an image index and a participant table to the curated cohort."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.config import KEEP_SUFFIXES, MIN_LABELLED_SUBJECTS, InclusionLimits
from cohortloom.functions.arrays import array_product, field_of_view, n_dims
from cohortloom.functions.missing import nan_to_null
from cohortloom.operators.aggregates import cohort_counts, eligible_groups, overview
from cohortloom.operators.dedup import dedup_first
from cohortloom.operators.filters import include_mask
from cohortloom.operators.joins import exclude, join_m1, semi
from cohortloom.operators.ordering import path_key, top_k


def select_images(
    images: DataFrame, exclusions: DataFrame | None, suffixes: Sequence[str] = KEEP_SUFFIXES
) -> DataFrame:
    """Images of the wanted suffixes outside the excluded datasets."""
    kept = images.filter(F.col("suffix").isin(*suffixes))
    return kept if exclusions is None else exclude(kept, exclusions, ["dataset"])


def with_geometry(images: DataFrame) -> DataFrame:
    """Number of axes, coarsest voxel side, field of view and its volume."""
    voxel = F.transform("pixdim", nan_to_null)
    return images.withColumns(
        {"ndim": n_dims(F.col("shape")), "res": F.array_max(voxel), "fov": field_of_view(F.col("shape"), voxel)}
    ).withColumn("vol", array_product(F.col("fov")))


@dataclass(frozen=True)
class Cohort:
    """Curated images, the same joined to participants, and one row of counts."""

    images: DataFrame
    joined: DataFrame
    counts: DataFrame


def curate(
    images: DataFrame,
    participants: DataFrame,
    exclusions: DataFrame | None = None,
    limits: InclusionLimits = InclusionLimits(),
    suffixes: Sequence[str] = KEEP_SUFFIXES,
) -> Cohort:
    """Mask, then deduplicate by content, then join; an excluded copy never shadows a kept one.

    ``participants`` must be unique on (dataset, sub).
    """
    chosen = select_images(images, exclusions, suffixes)
    masked = chosen.filter(include_mask(limits))
    unique = dedup_first(masked, ["md5"], [path_key(F.col("path"))])
    people = participants if exclusions is None else exclude(participants, exclusions, ["dataset"])
    joined = join_m1(
        unique, people, ["dataset", "sub"], "left", match_flag="matched", check="later"
    )
    return Cohort(unique, joined, cohort_counts(unique, "dataset", "sub", "suffix", suffixes))


def dataset_overview(joined: DataFrame) -> DataFrame:
    return overview(joined, "dataset", "path", "sub", "age")


def large_datasets(per_dataset: DataFrame, minimum: int = 200, k: int = 20) -> DataFrame:
    """Datasets with the most subjects."""
    return top_k(per_dataset.filter(F.col("n_subs") >= minimum), "n_subs", k, ["dataset"], True)


def dense_datasets(per_dataset: DataFrame, minimum: float = 10, k: int = 20) -> DataFrame:
    """Datasets with the most images per subject."""
    chosen = per_dataset.filter(F.col("im_per_sub") >= minimum)
    return top_k(chosen, "im_per_sub", k, ["dataset"], True)


def labelled_subjects(joined: DataFrame, minimum: int = MIN_LABELLED_SUBJECTS) -> DataFrame:
    """One labelled row per subject of the datasets with enough labelled subjects."""
    labelled = joined.filter(F.col("age").isNotNull())
    eligible = eligible_groups(labelled, "dataset", "sub", minimum)
    chosen = semi(labelled, eligible, ["dataset"])
    return dedup_first(chosen, ["dataset", "sub"], [path_key(F.col("path"))])
