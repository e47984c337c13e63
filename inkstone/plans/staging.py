"""Staging of intermediate tables in the folder that all machines of a cluster share.

A staged table cuts lineage: what is written once is read by every later step, and a lost
executor costs a re-read rather than a re-computation.  Spark's job commit decides which
task attempts count, so retried or speculative tasks do no harm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no spark.checkpoint.dir (tests, notebooks).
FALLBACK = "file:///tmp/checkpoints/inkstone"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one where it is unset and the session too
    is local.  On a cluster executors would each write to a disk of their own, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = FALLBACK
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return the table as read from there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path  # for drop()
    return back


def drop(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    path = getattr(df, "_staged_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever file system it is on."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
