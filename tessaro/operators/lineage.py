"""Cutting lineage where a result is read several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is named, a folder of this machine in local mode, as in tests; on a
    cluster that is an error, as executors wouldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.mkdtemp(prefix='spark-work-')}"


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the folder of shared_root, so that what reads it more than once doesn't compute it again, and
    lost executors don't lose it."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()
