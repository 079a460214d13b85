"""Algebra of ordered sets: DataFrames of one schema whose rows count once."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ordering import ascending


def _same(frames: tuple[DataFrame, ...]) -> list[str]:
    if not frames:
        raise ValueError("no sets")
    kinds = [[(c.name, c.dataType) for c in f.schema] for f in frames]
    if any(k != kinds[0] for k in kinds):
        raise ValueError("sets must have the same columns and types, and so the same order")
    return frames[0].columns


def empty(like: DataFrame) -> DataFrame:
    """The set of no rows, with the columns of another."""
    return like.limit(0)


def singleton(like: DataFrame, *values: Any) -> DataFrame:
    """The set of one row, with the columns of another."""
    return like.sparkSession.createDataFrame([values], like.schema)


def union(*sets: DataFrame) -> DataFrame:
    _same(sets)
    return reduce(DataFrame.union, sets).distinct()


def intersection(*sets: DataFrame) -> DataFrame:
    _same(sets)
    return reduce(DataFrame.intersect, sets) if len(sets) > 1 else sets[0].distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    _same((a, b))
    return a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """What only one of the two has, by one count of both sides rather than a union less an intersection."""
    names = _same((a, b))
    both = a.distinct().withColumn("_side", F.lit(1)).union(b.distinct().withColumn("_side", F.lit(2)))
    return both.groupBy(*names).agg(F.sum("_side").alias("_side")).where("_side < 3").select(*names)


def ordered(a: DataFrame) -> DataFrame:
    return a.orderBy(*ascending(*a.columns))
