"""File inventories, file lists, digests and the resumable index."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators.filters import visible_images
from cohortloom.operators.joins import keyed_join
from cohortloom.session import materialize
from cohortloom.sources.images import describe_files, open_root

#: Folders that a task lists, and entries that it hands on together.
TASK_FOLDERS = 2_000
BATCH_ENTRIES = 10_000


def relative_path(path: Column, root: str) -> Column:
    """Path below the absolute ``root``, whatever scheme prefix the reader adds."""
    mark = "/" + root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    start = F.instr(path, mark)
    return F.when(start > 0, F.substr(path, start + len(mark))).otherwise(path)


def _binary_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
    )


def _invisible(name: str, is_folder: bool) -> bool:
    """Whether Spark's readers pass over a file or folder of this name."""
    if name.startswith("_") and "=" not in name:
        return not (is_folder and name.startswith(("_common_metadata", "_metadata")))
    return name.startswith(".") or name.endswith("._COPYING_")


def _entries(folders: DataFrame, root: str) -> DataFrame:
    """``path, size, is_folder`` of what the folders (``path``, below ``root``) hold, one level down."""

    def rows(found: list[tuple]) -> pa.RecordBatch:
        paths, sizes, kinds = zip(*found) if found else ((), (), ())
        columns = [pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(kinds, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["path", "size", "is_folder"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_root(root)
        found = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                # a folder that has gone since is empty
                for info in system.get_file_info(arrow_fs.FileSelector(f"{top}/{folder}".rstrip("/") or "/", allow_not_found=True)):
                    is_folder = info.type == arrow_fs.FileType.Directory
                    if not _invisible(info.base_name, is_folder):
                        found.append((f"{folder}/{info.base_name}" if folder else info.base_name, info.size, is_folder))
                    if len(found) >= BATCH_ENTRIES:
                        yield rows(found)
                        found = []
        yield rows(found)

    return folders.mapInArrow(run, "path string, size long, is_folder boolean")


def _is_folder(root: str) -> bool:
    """Whether Arrow's file systems know ``root`` as a folder; a pattern is none."""
    try:
        system, top = open_root(root)
        return not re.search(r"[*?\[{\\]", root) and system.get_file_info(top).type == arrow_fs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


def scan_files(
    spark: SparkSession, root: str, glob: str = "*.nii*", drop: str = "bidsignore"
) -> DataFrame:
    """All matching files below ``root``: relative ``path`` and ``size``; contents are not read.

    Folders are listed in tasks, a level of the tree at a time, and what they hold is stored: the driver sees
    neither files nor folders. Patterns of folders, and stores that only Spark knows, go through Spark's listing.
    Hidden names, empty files and paths holding ``drop`` are left out.  Sort with
    :func:`cohortloom.operators.ordering.order_by_path`.
    """
    if not _is_folder(root):
        files = _binary_files(spark, root, glob)
        listing = files.select(relative_path(F.col("path"), root).alias("path"), F.col("length").alias("size"))
        return listing.filter(visible_images(F.col("path"), drop))
    if ":" not in root:
        root = os.path.abspath(root)
    name = F.substring_index("path", "/", -1)
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern.compile(glob).pattern()
    levels, folders = [], spark.createDataFrame([("",)], "path string").coalesce(1)
    while True:
        level = materialize(_entries(folders, root), "listing")
        files = level.filter(~F.col("is_folder") & (F.col("size") > 0) & name.rlike(f"(?s)\\A(?:{pattern})\\z"))
        levels.append(files.select("path", "size").filter(visible_images(F.col("path"), drop)))
        below = level.filter("is_folder").select("path")
        n = below.count()
        if not n:
            return reduce(DataFrame.unionAll, levels)
        tasks = max(-(-n // TASK_FOLDERS), min(n, spark.sparkContext.defaultParallelism))
        folders = below.repartition(tasks)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One path per line."""
    lines = spark.read.text(path).select(F.trim("value").alias("path"))
    return lines.filter(F.col("path") != "")


def write_list(df: DataFrame, path: str, column: str = "path") -> None:
    df.select(F.col(column).alias("value")).write.text(path)


def decoded(uri: Column) -> Column:
    """A percent-encoded file URI as a plain path."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def list_or_scan(spark: SparkSession, root: str, stored: str, glob: str = "*.nii*") -> DataFrame:
    """The stored list when there is one; otherwise scan, store and return the scan."""
    try:
        return read_list(spark, stored)
    except Exception as error:  # noqa: BLE001 - Spark reports a missing path at analysis
        if "PATH_NOT_FOUND" not in str(error):
            raise
    write_list(scan_files(spark, root, glob), stored)
    return read_list(spark, stored)


def read_exclusions(spark: SparkSession, path: str, name: str = "dataset") -> DataFrame:
    """Dataset ids of a list such as ``- ds000001  # reason``; comment lines are skipped."""
    found = F.regexp_extract("value", r"^- *([^\s#]+)", 1)
    return spark.read.text(path).select(found.alias(name)).filter(F.col(name) != "").distinct()


def with_md5(df: DataFrame, col: str, name: str = "md5") -> DataFrame:
    """Content digest of a text or binary column; NULL content gives NULL."""
    return df.withColumn(name, F.md5(F.col(col).cast("binary")))


def file_digests(spark: SparkSession, root: str, listing: DataFrame) -> DataFrame:
    """The listing with the digest of each file; files that cannot be read get NULL.

    Files of any size are read in pieces, and only 32 characters per file move on.
    """
    digests = describe_files(listing.select("path").distinct(), root).select("path", "md5")
    return listing.join(digests, "path", "left")


def incremental_index(listing: DataFrame, done: DataFrame, path: str = "path") -> DataFrame:
    """Listed files that have not been indexed yet."""
    return keyed_join(listing, done.select(path), [path], "left_anti")
