"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset a local session gets a temporary folder, a cluster an error:
    executors could not share the driver's disk."""
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    chosen = spark.conf.get("spark.checkpoint.dir", None)
    if not chosen:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        chosen = tempfile.mkdtemp(prefix="netloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(chosen)
    return chosen


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder: later reads survive lost executors and don't compute it again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
