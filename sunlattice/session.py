"""Session settings that the operators need."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """The cluster's spark.checkpoint.dir; a folder of our own only where none is set, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_checkpoints(spark).read.parquet(f"{sf_dir}/{name}.parquet")
