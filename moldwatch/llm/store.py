"""Intermediate tables in the folder that the cluster shares.

Executors can be lost at any time, and driver and executors have no local
folder in common.  What is used more than once is therefore written as Parquet
below ``spark.checkpoint.dir`` and read again; the files go when the
application ends.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from moldwatch.session import checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop.getParent())
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once: written to the shared folder and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
