"""Checks of stored indexes against the objects, and repairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.index import IndexView


def missing_entries(view: IndexView, stored: DataFrame) -> DataFrame:
    """Entries that the objects call for and the stored index lacks."""
    return view.as_set(ordered=False).subtract(stored.select(*view.columns))


def orphan_entries(view: IndexView, stored: DataFrame) -> DataFrame:
    """Entries of the stored index that no object calls for."""
    return stored.select(*view.columns).subtract(view.as_set(ordered=False))


def report(view: IndexView, stored: DataFrame) -> DataFrame:
    """(problem, columns...): both by one count of both sides."""
    names = view.columns
    both = view.as_set(ordered=False).withColumn("_side", F.lit(1)).unionByName(stored.select(*names).distinct().withColumn("_side", F.lit(2)))
    odd = both.groupBy(*names).agg(F.sum("_side").alias("_side")).where("_side < 3")
    return odd.select(F.when(F.col("_side") == 1, "missing").otherwise("orphan").alias("problem"), *names)


def repaired(view: IndexView, stored: DataFrame) -> DataFrame:
    """The stored index without orphans and with what was missing."""
    names = view.columns
    kept = stored.select(*names).join(orphan_entries(view, stored), list(names), "left_anti") if not _nullable(stored, names) else stored.select(*names).subtract(orphan_entries(view, stored))
    return kept.unionByName(missing_entries(view, stored))


def _nullable(df: DataFrame, names: Sequence[str]) -> bool:
    """Whether a join on the columns could miss rows: null equals null for the index, not for a join."""
    return any(f.nullable for f in df.schema if f.name in names)


def malformed(rows: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """(_id, problem) of objects without an id, or with a repeated one, or without a required field."""
    parts = rows.where("_id is null").select("_id", F.lit("no id").alias("problem"))
    parts = parts.unionByName(rows.groupBy("_id").count().where("count > 1 and _id is not null").select("_id", F.lit("repeated id").alias("problem")))
    for c in required:
        parts = parts.unionByName(rows.where(F.col(c).isNull()).select("_id", F.lit(f"no {c}").alias("problem")))
    return parts
