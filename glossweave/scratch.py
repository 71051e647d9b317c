"""Tables that are written once and read by several parts of a plan."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a single machine (tests) may have it unset, and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="glossweave-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, that is deleted when the session ends."""
    path = f"{scratch_dir(spark)}/glossweave-{uuid.uuid4().hex}"
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(named)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it again: what is below it is computed once, and the loss of an executor costs nothing of it."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
