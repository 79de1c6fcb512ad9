"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names. Where that is unset and the master is
    a single local JVM (as in tests) a temporary folder is made and set; on a cluster
    an unset folder is an error, since a machine-local one would lose data.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="lapsegrid-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept_as(frame: DataFrame, name: str) -> DataFrame:
    """A frame written to the shared folder and read back: lineage ends there, and a lost executor costs a re-read."""
    spark = frame.sparkSession
    path = fresh_dir(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def shuffled(frame: DataFrame) -> DataFrame:
    """A side of a join that is never sent whole to the driver and all workers: rows of a few numbers take a small part of
    their size in memory as Parquet, so that the size of files says nothing."""
    return frame.hint("merge")
