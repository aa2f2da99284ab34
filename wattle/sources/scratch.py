"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from wattle.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under a fresh name in the shared folder and read back: evaluated once, with sizes that
    the planner knows, and safe from lost executors.  Tables stay until the folder is cleared (``forget``)."""
    path = scratch_path(df.sparkSession, f"tables/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark) -> None:
    """Remove all tables that ``written`` left in the shared folder; for use when no query that reads one is running."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "tables"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
