"""Derived tables that are read more than once are written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; an own temporary folder only where it is unset and everything runs on this machine."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found and not context.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="orefolio-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


#: What this process has staged and not released.
_STAGED: list[str] = []


def release_staged(spark: SparkSession) -> int:
    """Delete all that was staged so far, once the results that were made of it are written; returns the number of folders. A result
    that is read later than that no longer has its input."""
    gone = 0
    while _STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: computed once, safe from lost executors, with true sizes for later joins."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
