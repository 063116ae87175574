"""Reliable materialization of an intermediate that several branches read.

``checkpoint()`` writes the frame to the shared folder named by the
session (``spark.checkpoint.dir``) and cuts its lineage, so a lost
executor re-reads the files instead of recomputing the whole subtree,
and each consumer scans the files instead of re-running the work.
"""

from __future__ import annotations

import gc
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

RELEASE_S = 0.3   # after a job's end, until nothing holds its shuffles


def materialize(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a compressed table under the shared checkpoint folder: a fraction of a checkpoint's rows on disk. Readers
    may not rely on how its rows stand in partitions."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Scratch:
    """A written table whose folder its job deletes as soon as nothing reads it any more."""
    df: DataFrame
    path: str

    def drop(self) -> None:
        discard(self.df.sparkSession, self.path)


def scratch_table(df: DataFrame, name: str) -> Scratch:
    """``written``, with the folder known to the caller; the shuffles of its making are released."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    release_shuffles(df.sparkSession)
    return Scratch(df.sparkSession.read.schema(df.schema).parquet(path), path)


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark's cleaner delete the shuffle files of jobs that are over: it does so for what the driver's collector has found
    unreachable, and a driver of much free memory collects too seldom. What the last job leaves is let go of a moment after its end."""
    gc.collect()
    time.sleep(RELEASE_S)
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch_path`` named, once nothing reads it any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, for tables a job
    writes and reads back (never a machine-local temp folder on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
