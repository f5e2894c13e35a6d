"""Where a plan is cut, so that what is computed is computed once and outlives lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset ``folder``, or in local mode alone one that is made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or folder
        if named is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillspark-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` through that folder."""
    shared_folder(df.sparkSession, folder)
    return df.checkpoint()
