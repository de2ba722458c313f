"""What has to be run for which scan, and how it went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.config import OUTPUT_DIRECTORIES, TEMPLATE_SPACE
from cohortloom.functions.names import base_name, image_stem, output_layout, plan_paths
from cohortloom.operators.filters import outside_directories
from cohortloom.operators.joins import keyed_join
from cohortloom.operators.ordering import path_key, take_exact
from cohortloom.operators.positions import batch_slice, with_position

STAGE_OUTPUTS = {"register": ("processed", "xfm"), "segment": ("seg", "vol", "qc"), "mask": ("mask",)}
OUTPUTS = ("processed", "xfm", "mask", "seg", "vol", "qc")


def outputs_present(listing: DataFrame, root: str, space: str = TEMPLATE_SPACE) -> DataFrame:
    """Which outputs exist per image stem, read off the listed paths: ``stem`` and six flags."""
    path = F.col("path")
    kind, stem = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (folder, ending) in output_layout(root, space).items():
        hit = path.startswith(folder) & path.endswith(ending)
        inner = F.substring(path, F.lit(len(folder) + 1), F.length(path) - len(folder) - len(ending))
        kind = F.when(hit, F.lit(name)).otherwise(kind)
        stem = F.when(hit, inner).otherwise(stem)
    found = listing.select(kind.alias("_kind"), stem.alias("stem")).filter("_kind is not null")
    return found.groupBy("stem").agg(*[F.bool_or(F.col("_kind") == o).alias(f"has_{o}") for o in OUTPUTS])


def work_status(
    plan: DataFrame, listing: DataFrame, root: str, path: str = "path", space: str = TEMPLATE_SPACE
) -> DataFrame:
    """Status of each planned scan: ``register``, ``segment``, ``mask only`` or ``done``.

    The listing is reduced to one row per stem before the shuffle; one join then settles all six
    outputs of a scan.
    """
    stemmed = plan.withColumn("stem", image_stem(F.col(path)))
    joined = keyed_join(stemmed, outputs_present(listing, root, space), ["stem"], "left")
    flags = [f"has_{o}" for o in OUTPUTS]
    joined = joined.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})
    return joined.withColumn("status", status_of()).drop("stem")


def status_of() -> Column:
    """Next step from the six ``has_…`` flags."""

    def all_of(stage: str) -> Column:
        out = F.lit(True)
        for o in STAGE_OUTPUTS[stage]:
            out = out & F.col(f"has_{o}")
        return out

    return (
        F.when(~all_of("register"), "register")
        .when(~all_of("segment"), "segment")
        .when(~all_of("mask"), "mask only")
        .otherwise("done")
    )


def plan_work(
    listing: DataFrame, root: str, batch_id: int = 0, batch_size: int | None = None
) -> DataFrame:
    """Inputs outside the output directories, one batch of them, with output paths and status."""
    inputs = listing.filter(
        outside_directories(F.col("path"), OUTPUT_DIRECTORIES, root) & F.col("path").endswith(".nii.gz")
    ).select("path")
    if batch_size is not None:
        keyed = inputs.withColumn("_parts", path_key(F.col("path")))
        inputs = batch_slice(keyed, ["_parts"], batch_id, batch_size).drop("_parts")
    return work_status(plan_paths(inputs, root), listing, root)


def outcome(status: DataFrame, stage: str = "stage", state: str = "status") -> DataFrame:
    """Scans per stage and state."""
    return status.groupBy(stage, state).agg(F.count(F.lit(1)).alias("n"))


def has_failures(status: DataFrame, state: str = "status", failed: str = "failed") -> bool:
    """Whether the run as a whole failed."""
    return not status.filter(F.col(state) == failed).isEmpty()


def manifest(listing: DataFrame, n: int, target: str, path: str = "path") -> DataFrame:
    """The first n images by name: position, file name, source and link path."""
    chosen = take_exact(listing.select(path), [path_key(F.col(path))], n)
    name = base_name(F.col(path))
    return with_position(chosen.withColumn("_parts", path_key(F.col(path))), ["_parts"], name="index").select(
        "index",
        name.alias("filename"),
        F.col(path).alias("source_path"),
        F.concat(F.lit(f"{target.rstrip('/')}/"), name).alias("symlink_path"),
    )
