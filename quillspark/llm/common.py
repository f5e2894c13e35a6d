"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII letters that lower-casing touches.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(col, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """Where lineage is cut: the session's ``spark.checkpoint.dir``. Where that is unset one is made, in local mode alone."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillspark-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage through the shared folder, by rows: for narrow tables that are read whole."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder at which nothing is yet."""
    return f"{shared_folder(spark)}/tables/{uuid.uuid4()}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: for wide tables, of which later steps read some columns."""
    path = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_stats(df: DataFrame, stats: DataFrame, keys: list[str], salt_by: Column, max_broadcast_rows: int = 50_000, salts: int = 32) -> DataFrame:
    """Left join of one row of ``stats`` per key, safe for hot keys.

    ``stats`` must be cheap to read twice (a checkpoint). It is counted first: up to ``max_broadcast_rows`` rows it is
    broadcast, beyond that each key is dealt out over ``salts`` partitions, so that no key's rows meet in one task.
    Keys must not be null.
    """
    if stats.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        return df.join(F.broadcast(stats), keys, "left")
    salted = stats.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).join(salted, [*keys, "__salt"], "left").drop("__salt")
