"""From image files to the image index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.names import parse_entities, promote
from cohortloom.operators.quality import split_valid
from cohortloom.operators.reshape import in_order
from cohortloom.session import materialize
from cohortloom.sources.files import relative_path, scan_files
from cohortloom.sources.images import describe_files, read_images
from cohortloom.streaming.index import run_available, stream_files

ENTITIES = ("sub", "ses", "run", "acq", "rec", "ce", "rez", "echo", "part", "task")
INDEX_TAIL = ("suffix", "shape", "pixdim", "dtype", "orient", "size", "md5", "path")


def index_rows(files: DataFrame, entities: Sequence[str] = ENTITIES) -> DataFrame:
    """Index rows of files as read by :mod:`cohortloom.sources.images`, with ``reject_reason``.

    A bad name is told before a bad file. All entities of a name stay in the map ``entities``; the listed ones
    are columns as well.
    """
    named = parse_entities(files)
    reason = F.coalesce("reject_reason", "read_error", "header_error")
    rows = promote(named.withColumn("reject_reason", reason), entities).drop("header_error", "read_error", "datatype")
    return in_order(rows.select("dataset", *entities, "entities", "reject_reason", *INDEX_TAIL), INDEX_TAIL)


def index_images(
    spark: SparkSession, root: str, glob: str = "*.nii*", drop: str = "bidsignore", listing: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Index of all images below ``root``, and the files that could not be indexed.

    Every listed file is in one of the two. Rejected are names that break the rules, unreadable headers, files that
    cannot be read, and files above ``spark.sql.sources.binaryFile.maxLength`` where the session sets it;
    without it there is no limit, for files are read in pieces. ``drop`` is looked for below ``root`` only.
    A ``listing`` (column ``path``) wins over a scan of the folder: it is taken as it is.
    """
    largest = largest_file(spark)
    if listing is not None:
        files, large = describe_files(listing, root), None
    else:
        files = read_images(spark, root, pathGlobFilter=glob, drop=drop, **({"maxLength": largest} if largest else {}))
        large = scan_files(spark, root, glob, drop).filter(F.col("size") > largest) if largest else None
    good, bad = split_valid(materialize(index_rows(files), "index"))
    return good, bad if large is None else bad.unionByName(unread(large, largest), allowMissingColumns=True)


def largest_file(spark: SparkSession) -> int | None:
    """Bytes of the largest file that the session lets be read; None where it says nothing."""
    return int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", "0")) or None


def unread(listing: DataFrame, largest: int) -> DataFrame:
    """Listed files that were not read, with the reason."""
    return listing.select("path", "size", F.lit(f"more than {largest} bytes").alias("reject_reason"))


def update_index(
    spark: SparkSession, root: str, out: str, checkpoint: str, glob: str = "*.nii*", drop: str = "bidsignore"
) -> DataFrame:
    """Add the files that are new since the last call to the index at ``out`` and return it all.

    Rejected files are recorded with their reason, so they are not read again; a file that fails to be read does
    not stop the stream. The stream moves paths only, and each file is read in pieces where its path arrives.
    """
    largest = largest_file(spark)

    def rows(files: DataFrame) -> DataFrame:
        below = files.select(relative_path(F.col("path"), root).alias("path"), F.col("length").alias("size"))
        below = below.filter(~F.col("path").contains(drop))
        if not largest:
            return index_rows(describe_files(below, root, size="size"))
        read = index_rows(describe_files(below.filter(F.col("size") <= largest), root, size="size"))
        return read.unionByName(unread(below.filter(F.col("size") > largest), largest), allowMissingColumns=True)

    run_available(stream_files(spark, root, glob), rows, out, checkpoint)
    return spark.read.parquet(out)
