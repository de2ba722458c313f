"""Resumable indexing as a stream over files: the checkpoint remembers what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, root: str, glob: str = "*.nii*") -> DataFrame:
    """New files below ``root`` as a stream of ``path, modificationTime, length, content``."""
    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
        .load(root)
    )


def run_available(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> None:
    """Index everything that is new since the last run, then stop.

    The file source records finished files in ``checkpoint`` and the Parquet sink commits each
    batch once, so a run that is lost half-way neither skips nor repeats a file.
    """
    query = (
        transform(stream)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
