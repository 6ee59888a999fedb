"""Cutting lineage in the folder that all executors share, and dealing out small tables."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and for tables that a job writes for itself.

    The folder is the cluster's own `spark.checkpoint.dir`. Where a session names none, a temporary
    folder is set if all runs on this machine; elsewhere executors would not share it, so that is
    an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint `df` reliably, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many partitions as the session runs tasks, before work that is heavy for each row.

    A table in one file of one row group is one task, however many cores wait. A table of many splits stays as it
    lies, so nothing is shuffled where it is large.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` written as Parquet under a fresh name in the shared folder and read from there; and where it lies."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes what a job has stored and nobody reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
