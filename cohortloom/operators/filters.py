"""Row filters of the curation, the QC gate and the regional tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.config import QC_THRESHOLD, InclusionLimits, OutlierLimits
from cohortloom.functions.arrays import axis, field_of_view, n_dims
from cohortloom.functions.missing import nan_to_null
from cohortloom.functions.scalars import megabytes
from cohortloom.operators.joins import keyed_join, semi


def inclusion_terms(
    limits: InclusionLimits = InclusionLimits(),
    shape: str = "shape",
    pixdim: str = "pixdim",
    size: str = "size",
) -> dict[str, Column]:
    """The nine named terms of the inclusion mask; NaN and NULL never pass."""
    voxel = F.transform(F.col(pixdim), nan_to_null)
    fov = field_of_view(F.col(shape), voxel)
    mb = megabytes(F.col(size))
    whole = F.forall(voxel, lambda v: v.isNotNull())
    return {
        "ndim": n_dims(F.col(shape)) == limits.ndim,
        "size_low": mb >= limits.size_mb_low,
        "size_high": mb <= limits.size_mb_high,
        "voxel_low": whole & (F.array_min(voxel) >= limits.voxel_low),
        "voxel_x": axis(voxel, 0) <= limits.inplane_high,
        "voxel_y": axis(voxel, 1) <= limits.inplane_high,
        "voxel_z": axis(voxel, 2) <= limits.slice_high,
        "fov_low": F.array_min(fov) >= limits.fov_low,
        "fov_high": F.array_max(fov) <= limits.fov_high,
    }


def include_mask(limits: InclusionLimits = InclusionLimits(), **columns: str) -> Column:
    """Conjunction of all terms as a two-valued column."""
    terms = inclusion_terms(limits, **columns).values()
    return F.coalesce(reduce(lambda a, b: a & b, terms), F.lit(False))


def outlier_masks(
    limits: OutlierLimits = OutlierLimits(), shape: str = "shape", size: str = "size"
) -> dict[str, Column]:
    return {
        "not_3d": n_dims(F.col(shape)) != 3,
        "very_small": F.col(size) < limits.small_bytes,
        "very_big": F.col(size) > limits.big_bytes,
    }


def qc_gate(score: Column, minimum: float | None, null_passes: bool = True) -> Column:
    """Scores at or above the minimum; scans without a score pass unless told otherwise."""
    if minimum is None:
        return F.lit(True)
    return F.coalesce(nan_to_null(score) >= minimum, F.lit(null_passes))


def require_category(df: DataFrame, key: Sequence[str], category: str, value: str) -> DataFrame:
    """Keep the groups that hold a required category."""
    holders = df.filter(F.col(category) == value).select(*key)
    return keyed_join(df, holders, key, "left_semi")


def complete_categories(df: DataFrame, key: str, category: str, value: str) -> DataFrame:
    """Drop categories that are missing, or NULL, for any key: dropping columns, in long form.

    (key, category) must be unique; then counting rows, combined before the shuffle, is enough.
    """
    n_keys = df.agg(F.count_distinct(key).alias("n")).scalar()
    complete = df.groupBy(category).agg(F.count(value).alias("_n")).filter(F.col("_n") == n_keys)
    return semi(df, complete, [category])


def below_threshold(long: DataFrame, score: str, threshold: float = QC_THRESHOLD) -> DataFrame:
    """Rows of a long score table below the threshold; NULL and NaN never flag."""
    return long.filter(nan_to_null(F.col(score)) < threshold)


def outside_directories(path: Column, directories: Sequence[str], root: str = "") -> Column:
    """Paths that do not lie below one of the output directories."""
    base = f"{root.rstrip('/')}/" if root else ""
    return reduce(lambda a, b: a & b, [~path.startswith(f"{base}{d}/") for d in directories])


def visible_images(path: Column, drop: str = "bidsignore") -> Column:
    """Names that are not hidden, in paths without the ignore marker."""
    return ~F.substring_index(path, "/", -1).startswith(".") & ~path.contains(drop)
