"""Sorted key/value entries to and from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "key binary, value binary"


def write_sorted(kv: DataFrame, path: str, partitions: int) -> None:
    """Entries as Parquet files of neighbouring ranges of keys, sorted: a range of keys reads few files and few of their
    row groups, by their least and greatest keys."""
    kv.repartitionByRange(partitions, "key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def read_sorted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRY).parquet(path)


def write_xml(kv: DataFrame, path: str) -> None:
    """Entries as XML, keys and values in hexadecimal."""
    kv.select(F.lower(F.hex("key")).alias("key"), F.lower(F.hex("value")).alias("value")).write.format("xml").option("rowTag", "kv").option("rootTag", "entries").mode("overwrite").save(path)


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "kv").schema("key string, value string").load(path)
    return raw.select(F.unhex("key").alias("key"), F.coalesce(F.unhex("value"), F.lit(b"")).alias("value"))
