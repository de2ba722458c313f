"""Session settings and shared working folders."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(
    master: str = "local[8]", name: str = "cohortloom", shuffle_partitions: int = 8, folder: str | None = None
):
    """A session for tests and benchmarks; on a cluster the submitter's settings apply."""
    folder = folder or os.path.join(tempfile.gettempdir(), "cohortloom-shared")
    spark = (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.checkpoint.dir", folder)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a session whose tasks run in the driver's own process may name none: it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="cohortloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_OWN: set[str] = set()


def working_path(spark: SparkSession, name: str) -> str:
    """A path nobody else uses, below the shared folder. All of them go when the program ends."""
    context = spark.sparkContext
    own = f"{shared_folder(spark).rstrip('/')}/cohortloom/{context.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_remove, context._jvm, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _remove(jvm, folder: str) -> None:
    """Delete a folder through Spark's file systems, if the JVM is still there."""
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session has gone, and nothing depends on the files
        pass


def materialize(df: DataFrame, name: str = "stage", **options) -> DataFrame:
    """Write ``df`` once and read it back; ``options`` are those of the Parquet writer.

    For results that several later jobs start from: nothing is recomputed, and a lost executor
    costs one re-read.
    """
    path = working_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
