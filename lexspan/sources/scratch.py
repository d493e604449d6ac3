"""Tables that a plan writes for itself, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a fresh local folder only in a local session that has none, as in tests."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if known is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        known = sc.getCheckpointDir()
    return known.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: the lineage ends there, and a lost executor costs no more than its tasks."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
