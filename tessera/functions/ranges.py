"""Ranges of about equally many rows, by approximate quantiles of a whole number, date or time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.lineage import cut

#: Cells that rows are cut into at most, at each of two levels.
MOST_CELLS = 1024
_WIDTH = 2 * MOST_CELLS


def place(splits: Column, value: Column, most: int = _WIDTH) -> Column:
    """How many of the sorted splits, an array of fewer than `most`, are at most `value`, by binary search; 0 for null. What
    the search looks at goes along with its state: the optimizer overlooks columns that are named in the lambda only."""
    steps = [most >> k for k in range(1, most.bit_length())]
    start = F.struct(F.lit(0).alias("at"), splits.alias("s"), value.alias("v"))

    def step(found: Column, x: Column) -> Column:
        further = F.get(found["s"], found["at"] + x - 1) <= found["v"]
        return F.struct(F.when(further, found["at"] + x).otherwise(found["at"]).alias("at"), found["s"].alias("s"), found["v"].alias("v"))

    return F.aggregate(F.array(*[F.lit(x) for x in steps]), start, step, lambda found: found["at"])


def quantiles(value: str, cells: int) -> Column:
    """Approximate quantiles that cut rows into `cells`, sorted, each once."""
    if cells < 2:
        return F.array().cast("array<double>")
    return F.array_sort(F.array_distinct(F.percentile_approx(value, [k / cells for k in range(1, cells)], 20 * cells))).cast("array<double>")


def number(value: Column, kind: str) -> Column:
    """A double that never falls as the value rises: of numbers, dates, times, and the first bytes of binary keys."""
    if kind == "date":
        return F.unix_date(value).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if kind == "binary":
        return F.conv(F.rpad(F.hex(F.substring(value, 1, 6)), 12, "0"), 16, 10).cast("double")
    return value.cast("double")


@dataclass(frozen=True)
class Cells:
    """Cells whose numbers rise with a double. A cell is cut at quantiles of its own out of an outer cell, in tasks of their
    own, so that no task sorts or counts all rows: up to MOST_CELLS ** 2 cells, beyond which they grow. `inner` has a row for
    each outer cell, up to MOST_CELLS, and is what is broadcast. It is cut once and kept: approximate quantiles may come out
    otherwise when they are asked for again, and rows that are put twice must be put alike."""

    outer: tuple[float, ...]
    inner: DataFrame | None

    @staticmethod
    def of(values: DataFrame, rows: int, per_cell: int) -> Cells:
        """Of about `per_cell` of the `rows` rows of `values` (v) each."""
        wanted = max(1, rows // per_cell)
        if wanted == 1:
            return Cells((), None)
        first = min(MOST_CELLS, max(1, -(-wanted // MOST_CELLS)))
        second = min(MOST_CELLS, -(-wanted // first))
        top = values.select(quantiles("v", first).alias("s")).first()[0] or [] if first > 1 else []
        placed = values.withColumn("_of", place(_literal(top), F.col("v")))
        return Cells(tuple(top), cut(placed.groupBy("_of").agg(quantiles("v", second).alias("_splits"))))

    def put(self, df: DataFrame, value: Column, name: str) -> DataFrame:
        """`df` with the number of the cell of a value, a long; 0 for null."""
        if self.inner is None:
            return df.withColumn(name, F.lit(0).cast("long"))
        df = df.withColumn("_outer", place(_literal(self.outer), value))
        joined = df.join(F.broadcast(self.inner), F.col("_outer") == F.col("_of"), "left")
        return joined.withColumn(name, F.col("_outer").cast("long") * _WIDTH + place(F.coalesce("_splits", _literal(())), value)).drop("_outer", "_of", "_splits")


def _literal(splits: tuple[float, ...] | list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in splits]).cast("array<double>")
