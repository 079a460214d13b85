"""The folder that the driver and all executors share, and cutting lineage between the rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; only where that is unset, as in tests on one machine, in a new
    temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """`df` from a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_path(df.sparkSession, "checkpoints"))
    return df.checkpoint()


#: Partitions, at least, of rows that are grouped one by one.
SPREAD_PARTS = 128


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` by its keys in many partitions, whatever the number that shuffles have, so that a task that holds all groups of
    one holds few."""
    return df.repartition(max(SPREAD_PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` read from Parquet in the shared folder, so that what depends on how its rows were dealt out stays as it was."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
