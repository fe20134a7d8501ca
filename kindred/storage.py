"""Intermediate tables and files in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_folders: set[str] = set()


def is_local(spark: SparkSession) -> bool:
    """True if the driver's own process runs all tasks (a local-cluster, or a cluster on localhost, doesn't)."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only a local session may go without that setting; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kindred-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the session's part of the shared folder; that part goes when the session's driver ends."""
    folder = f"{shared_dir(spark)}/kindred-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _folders.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system, and the path there; the scheme may be any that Arrow knows (file, hdfs, s3, gs, abfs)."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what an operator no longer needs."""
    with contextlib.suppress(Exception):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables that written() made and that no lazy result reads any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/kindred-" in path:
                drop_path(df.sparkSession, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table written to the shared folder: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
