"""The folder that driver and executors share, for what must be read twice as it was."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; on a local master without that setting, in a temporary folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="emberlog-shared-")
        sc.setCheckpointDir(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """df written to the shared folder and read back: any task that is repeated finds the same rows."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
