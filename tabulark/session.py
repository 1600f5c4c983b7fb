"""Shared storage for results that must not be recomputed differently."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: the session's checkpoint folder.

    A local session without one gets a fresh temporary folder. On a cluster the
    setting is required, because a folder of one machine would be lost with it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tabulark-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table written on the way."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Remove the tables this driver has written on the way; call it when no frame that reads them is needed any more.

    Returns how many there were. Checkpoints go by themselves with `spark.cleaner.referenceTracking.cleanCheckpoints`.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    removed = 0
    while _scratch:
        path = hadoop.Path(_scratch.pop())
        removed += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return removed


def materialize(df: DataFrame) -> DataFrame:
    """Write the frame once to reliable storage and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
