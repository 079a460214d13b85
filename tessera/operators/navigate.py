"""Ordered navigation: ends, neighbours, ranges, pages by key, and neighbours of many values at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.lineage import cut
from tessera.functions.ordering import ascending, descending
from tessera.functions.ranges import Cells, number
from tessera.operators.bounds import Bounds


def first(df: DataFrame, key: str, *ties: str) -> DataFrame:
    """The row with the smallest key; no row if there is none."""
    return df.orderBy(*ascending(key, *ties)).limit(1)


def last(df: DataFrame, key: str, *ties: str) -> DataFrame:
    return df.orderBy(*descending(key, *ties)).limit(1)


def required(df: DataFrame) -> DataFrame:
    """The same rows; an error if there are none."""
    if df.isEmpty():
        raise LookupError("no such element")
    return df


def poll_first(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The first row, and the rest. Keys are unique."""
    top = first(df, key)
    return top, df.join(top.select(F.col(key).alias("_top")), F.col(key).eqNullSafe(F.col("_top")), "left_anti")


def poll_last(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    top = last(df, key)
    return top, df.join(top.select(F.col(key).alias("_top")), F.col(key).eqNullSafe(F.col("_top")), "left_anti")


def lower(df: DataFrame, key: str, value: Any) -> DataFrame:
    """The row with the greatest key below the value."""
    return last(df.where(Bounds.lt(value).predicate(F.col(key))), key)


def floor(df: DataFrame, key: str, value: Any) -> DataFrame:
    return last(df.where(Bounds.le(value).predicate(F.col(key))), key)


def ceiling(df: DataFrame, key: str, value: Any) -> DataFrame:
    return first(df.where(Bounds.ge(value).predicate(F.col(key))), key)


def higher(df: DataFrame, key: str, value: Any) -> DataFrame:
    return first(df.where(Bounds.gt(value).predicate(F.col(key))), key)


def sub_set(df: DataFrame, key: str, bounds: Bounds, descending_order: bool = False) -> DataFrame:
    found = df.where(bounds.predicate(F.col(key)))
    return found.orderBy(*(descending if descending_order else ascending)(key))


def numbered(df: DataFrame, *order: Column, name: str = "place", partitions: int | None = None) -> DataFrame:
    """The rows with their places, from 1, in an order; ties get any. Rows are dealt out in ranges of the order, whose counts
    are the offsets, so that no task sees all."""
    n = partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [f"_o{i}" for i in range(len(order))]
    ranged = df.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(n, *[F.col(k).asc_nulls_last() for k in keys])
    dealt = cut(ranged.withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    offsets = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*[F.col(k).asc_nulls_last() for k in keys]))
    return dealt.withColumn("_inside", inside).join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_start") + F.col("_inside")).alias(name))


def floors(left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = (), *, carry: Sequence[str], inclusive: bool = True, cells: int | None = None, cell_rows: int = 200_000) -> DataFrame:
    """For each row of `left` the columns `carry` of the row of `right` with the greatest `on` at or below its own (below
    it, if not inclusive), among those with equal `by`; null if there is none. Of several rows with that `on`, the one whose
    columns `carry` are the greatest. `on` is a number, date or timestamp.

    The values of `on` are cut into cells of about `cell_rows` rows, wherever they lie, and rows are dealt by `by` and cell,
    so that one value of `by` with many rows, or none at all, doesn't end up in one task. What a row doesn't find in its
    cell is the last row of the nearest earlier cell, of which there is one row for each value of `by` and cell.
    """
    kind = dict(right.dtypes)[on]
    values = right.select(number(F.col(on), kind).alias("v")).unionByName(left.select(number(F.col(on), kind).alias("v")))
    rows = values.count()
    dealt = Cells.of(values.where("v is not null"), rows, max(1, rows // cells) if cells else cell_rows)
    packed, kept = F.struct(*carry), F.struct(*left.columns)
    mine = dealt.put(left.withColumn("_row", kept), number(F.col(on), kind), "_cell").select(*by, on, "_cell", F.lit(1 if inclusive else 0).alias("_side"), "_row", F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType).alias("_found"))
    theirs = dealt.put(right.where(F.col(on).isNotNull()), number(F.col(on), kind), "_cell").select(*by, on, "_cell", F.lit(0 if inclusive else 1).alias("_side"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), packed.alias("_found"))
    order = W.partitionBy(*by, "_cell").orderBy(F.col(on), "_side", "_found").rowsBetween(W.unboundedPreceding, 0)
    near = mine.unionByName(theirs).withColumn("_found", F.last("_found", ignorenulls=True).over(order)).where(F.col("_row").isNotNull())
    ends = theirs.groupBy(*by, "_cell").agg(F.max(F.struct(on, "_found")).alias("_end")).withColumn("_end", F.col("_end._found"))
    asked = near.where(F.col("_found").isNull() & F.col(on).isNotNull()).select(*by, "_cell").distinct().withColumn("_end", F.lit(None).cast(theirs.schema["_found"].dataType)).withColumn("_asked", F.lit(True))
    earlier = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("_cell", F.desc("_asked")).rowsBetween(W.unboundedPreceding, -1)  # a row for each cell
    carried = asked.unionByName(ends.withColumn("_asked", F.lit(False))).withColumn("_earlier", F.last("_end", ignorenulls=True).over(earlier))
    carried = carried.where("_asked").select(*[F.col(b).alias(f"_{b}") for b in by], F.col("_cell").alias("_at"), "_earlier")
    match = F.col("_cell").eqNullSafe(F.col("_at"))
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_{b}"))
    out = near.join(carried, match, "left")
    found = F.when(F.col(f"_row.{on}").isNotNull(), F.coalesce("_found", "_earlier"))
    return out.select(*[F.col(f"_row.{c}").alias(c) for c in left.columns], *[found[c].alias(f"floor_{c}") for c in carry])


@dataclass(frozen=True)
class Pager:
    """Pages by key: each page filters on the last key seen, so a late page costs no more than the first."""

    df: DataFrame
    key: str
    size: int = 100
    descending: bool = False
    where: Column | None = None
    cursor: tuple = field(default=())

    def _rows(self) -> DataFrame:
        return self.df if self.where is None else self.df.where(self.where)

    def page(self) -> DataFrame:
        """The rows after the cursor, in order."""
        rows = self._rows()
        if self.cursor:
            beyond = Bounds.lt if self.descending else Bounds.gt
            rows = rows.where(beyond(self.cursor[0]).predicate(F.col(self.key)))
        return rows.orderBy(*(descending if self.descending else ascending)(self.key)).limit(self.size)

    def at(self, key: Any) -> Pager:
        """With the cursor at a key: its page begins after it."""
        return replace(self, cursor=(key,))

    def filtered(self, where: Column) -> Pager:
        return replace(self, where=where, cursor=())

    def next(self) -> Pager:
        end = self.page().agg(F.expr(f"{'min' if self.descending else 'max'}({self.key})")).first()[0]
        return self if end is None else self.at(end)

    def first(self) -> Pager:
        return replace(self, cursor=())

    def previous(self) -> Pager:
        """The page before this one: as many rows that come last up to the cursor, and a cursor before them."""
        if not self.cursor:
            return self
        upto = (Bounds.ge if self.descending else Bounds.le)(self.cursor[0]).predicate(F.col(self.key))
        back = (ascending if self.descending else descending)(self.key)
        keys = [r[0] for r in self._rows().where(upto).orderBy(*back).select(self.key).limit(self.size + 1).collect()]  # a page's keys
        return self.at(keys[self.size]) if len(keys) > self.size else self.first()

    def last(self) -> Pager:
        back = (ascending if self.descending else descending)(self.key)
        keys = [r[0] for r in self._rows().orderBy(*back).select(self.key).limit(self.size + 1).collect()]
        return self.at(keys[self.size]) if len(keys) > self.size else self.first()
