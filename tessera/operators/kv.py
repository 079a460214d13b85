"""Sorted key/value data: ranges of keys, overlays of changes, conflicts, and watched keys. Keys are any ordered type."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.convert import key_after_prefix
from tessera.functions.lineage import written
#: Cells that ranges are dealt into at most, to be merged.
MOST_CELLS = 128
#: Partitions, at least, in which points and the ends of ranges are sorted.
PLACED_PARTS = 32
_POINT = 2


@dataclass(frozen=True)
class KeyRange:
    """Keys from min up to, without, max; None: no end."""

    min: Any = None
    max: Any = None

    @staticmethod
    def prefix(p: bytes) -> KeyRange:
        return KeyRange(p, key_after_prefix(p))

    def contains(self, key: Any) -> bool:
        return (self.min is None or key >= self.min) and (self.max is None or key < self.max)

    def overlaps(self, other: KeyRange) -> bool:
        return (self.max is None or other.min is None or other.min < self.max) and (other.max is None or self.min is None or self.min < other.max)

    def is_prefix(self, p: bytes) -> bool:
        return self == KeyRange.prefix(p)

    def is_single(self) -> bool:
        """Whether the range of binary keys holds one key."""
        return self.min is not None and self.max == self.min + b"\x00"

    def compare(self, key: Any) -> int:
        """-1 if the range lies below a key, 1 if above it, 0 if it holds it."""
        if self.min is not None and key < self.min:
            return 1
        return -1 if self.max is not None and key >= self.max else 0

    def predicate(self, key: Column) -> Column:
        out = F.lit(True)
        if self.min is not None:
            out = out & (key >= F.lit(self.min))
        if self.max is not None:
            out = out & (key < F.lit(self.max))
        return out


class KeyRanges:
    """A set of keys as ranges that do not touch, in order."""

    def __init__(self, ranges: Iterable[KeyRange] = ()):
        low = lambda r: (r.min is not None, r.min) if r.min is not None else (False,)
        out: list[KeyRange] = []
        for r in sorted((r for r in ranges if r.max is None or r.min is None or r.min < r.max), key=low):
            if out and (out[-1].max is None or r.min is None or r.min <= out[-1].max):
                a = out.pop()
                r = KeyRange(a.min, None if a.max is None or r.max is None else max(a.max, r.max))
            out.append(r)
        self.ranges = out

    def __eq__(self, other: object) -> bool:
        return isinstance(other, KeyRanges) and self.ranges == other.ranges

    __hash__ = None

    def contains(self, key: Any) -> bool:
        return any(r.contains(key) for r in self.ranges)

    def find(self, key: Any) -> KeyRange | None:
        """The range that holds a key."""
        return next((r for r in self.ranges if r.contains(key)), None)

    def seek_higher(self, key: Any) -> Any:
        """The smallest key from `key` on that may be in the set; None if there is none."""
        return next((key if r.contains(key) else r.min for r in self.ranges if r.max is None or r.max > key), None)

    def seek_lower(self, key: Any) -> Any:
        """The smallest upper end at or above which no key below `key` is in the set: keys below it may be. None if no key
        below `key` is."""
        return next((key if r.max is None or r.max > key else r.max for r in reversed(self.ranges) if r.min is None or r.min < key), None)

    def union(self, other: KeyRanges) -> KeyRanges:
        return KeyRanges([*self.ranges, *other.ranges])

    def inverse(self) -> KeyRanges:
        out, at = [], None
        for k, r in enumerate(self.ranges):
            if r.min is not None and (k > 0 or r.min is not None):
                out.append(KeyRange(at, r.min))
            at = r.max
            if at is None:
                return KeyRanges(out)
        return KeyRanges([*out, KeyRange(at, None)])

    def intersection(self, other: KeyRanges) -> KeyRanges:
        return self.inverse().union(other.inverse()).inverse()

    def difference(self, other: KeyRanges) -> KeyRanges:
        return self.intersection(other.inverse())

    def predicate(self, key: Column) -> Column:
        out = F.lit(False)
        for r in self.ranges:
            out = out | r.predicate(key)
        return out


def get(kv: DataFrame, key: Any, by: str = "key") -> DataFrame:
    return kv.where(F.col(by) == F.lit(key))


def at_least(kv: DataFrame, low: Any, high: Any = None, by: str = "key") -> DataFrame:
    """The entry with the smallest key from low on, below high."""
    return kv.where(KeyRange(low, high).predicate(F.col(by))).orderBy(by).limit(1)


def at_most(kv: DataFrame, high: Any, low: Any = None, by: str = "key") -> DataFrame:
    """The entry with the greatest key below high, from low on."""
    return kv.where(KeyRange(low, high).predicate(F.col(by))).orderBy(F.desc(by)).limit(1)


def scan(kv: DataFrame, ranges: KeyRange | KeyRanges, reverse: bool = False, by: str = "key") -> DataFrame:
    return kv.where(ranges.predicate(F.col(by))).orderBy(F.desc(by) if reverse else F.asc(by))


def prefixed(kv: DataFrame, prefix: bytes, by: str = "key") -> DataFrame:
    """The entries whose binary keys have a prefix, which is taken off: a store within a store."""
    rest = F.substring(F.col(by), F.lit(len(prefix) + 1), F.octet_length(by))
    return kv.where(KeyRange.prefix(prefix).predicate(F.col(by))).withColumn(by, rest)


def coalesced(ranges: DataFrame, by: Iterable[str] = (), per_cell: int = 200_000) -> DataFrame:
    """(by, min, max) rows merged where they touch or overlap.

    Ranges are dealt into cells of about `per_cell` rows, up to MOST_CELLS, by the order of `by` and their ends, those that
    are equal too, so that neither a hot value of `by` nor a lack of one puts all in one task. The cells are written, since
    a second deal may cut elsewhere. They are merged each by itself; from one to the next go how far its ranges reach and
    where its last merged range begins."""
    keys = list(by)
    n = min(MOST_CELLS, max(1, -(-ranges.count() // per_cell)))
    rows = ranges.select(*keys, "min", "max").withColumn("_tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(n, *keys, "min", "max", "_tie").drop("_tie").withColumn("_cell", F.spark_partition_id())
    cells = written(dealt, "cells").repartition(n, *keys, "_cell")
    order = W.partitionBy(*keys, "_cell").orderBy("min", "max")
    reach = F.max("max").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = cells.withColumn("_start", F.when(reach.isNull() | (F.col("min") > reach), F.col("min")))
    marked = marked.withColumn("_island", F.max("_start").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = marked.groupBy(*keys, "_cell", "_island").agg(F.min("min").alias("min"), F.max("max").alias("max")).drop("_island")
    if n == 1:
        return merged.drop("_cell")
    earlier = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)  # a row for each cell
    ends = merged.groupBy(*keys, "_cell").agg(F.max("min").alias("_last"), F.max("max").alias("_end")).withColumn("_reach", F.max("_end").over(earlier))
    # where the last merged range of a cell begins within reach of the earlier cells, all of the cell do
    begins = F.when(F.col("_reach").isNull() | (F.col("_last") > F.col("_reach")), F.col("_last"))
    ends = ends.withColumn("_begin", begins).withColumn("_before", F.max("_begin").over(earlier))
    ends = ends.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_cell").alias("_at"), "_reach", "_before")
    match = F.col("_cell") == F.col("_at")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    start = F.when(F.col("_reach").isNull() | (F.col("min") > F.col("_reach")), F.col("min")).otherwise(F.col("_before"))
    return merged.join(ends, match).select(*keys, "min", "max", start.alias("_island")).groupBy(*keys, "_island").agg(F.min("min").alias("min"), F.max("max").alias("max")).drop("_island")


def overlay(base: DataFrame, removed: DataFrame | None = None, puts: DataFrame | None = None, adjusts: DataFrame | None = None, ranges: KeyRanges | None = None, by: str = "key", value: str = "value") -> DataFrame:
    """A base with changes laid over it, in their order: keys and ranges removed, entries put, counters adjusted."""
    out = base.select(by, value)
    if ranges is not None:
        out = out.where(~ranges.predicate(F.col(by)))
    if removed is not None:
        out = out.join(removed.select(by), by, "left_anti")
    if puts is not None:
        out = out.join(puts.select(by), by, "left_anti").unionByName(puts.select(by, value))
    if adjusts is not None:
        total = adjusts.groupBy(by).agg(F.sum("delta").alias("_delta"))
        out = out.join(total, by, "left").select(by, (F.col(value) + F.coalesce("_delta", F.lit(0))).alias(value))
    return out


def fold_counters(adjusts: DataFrame, by: str = "key") -> DataFrame:
    """(key, value): counters from their adjustments."""
    return adjusts.groupBy(by).agg(F.sum("delta").cast("long").alias("value"))


def within_ranges(points: DataFrame, ranges: DataFrame, per_cell: int = 64, fan: int = 16) -> DataFrame:
    """The rows of `points` (key, ...) with the rows of `ranges` (min, max, ...) that hold their key: min <= key < max. The
    other columns must have different names. Keys are of any type that orders: numbers, dates, times, binary, text.

    Points get places in the order of keys, and ranges the places where they begin and end, by one sort of the keys and the
    ends together, whole, which is written, since a second sort may deal otherwise. Places are cut into cells of `per_cell`
    points; a range goes to the cells where it begins, ends, and in between (by way of cells `fan` times as wide, so that no
    row holds all cells of a long one), a point to its own. So each range meets a point that it holds in each of its cells, and
    the work is in proportion to what is found, wherever the keys lie and however many are equal."""

    def before(batches):  # a function within a function, which workers get by value
        """The rows of a partition, each with how many points come before it."""
        seen = 0
        for b in batches:
            point = np.asarray(b.column("_what")) == _POINT
            upto = seen + np.cumsum(point)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto - point, pa.int64())], names=[*b.schema.names, "_before"])
            seen = int(upto[-1]) if len(upto) else seen

    spark = points.sparkSession
    p = points.select("key", F.lit(_POINT).alias("_what"), F.struct(*points.columns).alias("_point"))
    ends = ranges.where("min < max").select(F.explode(F.array("min", "max")).alias("key"), F.lit(0).alias("_what"), F.struct(*ranges.columns).alias("_range"))
    rows = ends.unionByName(p, allowMissingColumns=True).withColumn("_tie", F.monotonically_increasing_id())
    order = ["key", "_what", "_tie"]  # ends come before the points of their key
    n = max(PLACED_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("_what", "_range", "_point", F.spark_partition_id().alias("_part"))
    dealt = written(rows.mapInArrow(before, T.StructType([*rows.schema, T.StructField("_before", T.LongType())])), "places")
    counts = dealt.groupBy("_part").agg(F.count_if(F.col("_what") == _POINT).alias("_n"))  # a row for each partition
    offsets = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))
    placed = dealt.join(F.broadcast(offsets), "_part").withColumn("_place", F.col("_start") + F.col("_before"))
    found = placed.where(F.col("_what") != _POINT).groupBy("_range").agg(F.min("_place").alias("_low"), F.max("_place").alias("_high"), F.count("*").alias("_ends"))
    again = found.where("_low < _high").withColumn("_again", F.explode(F.expr("sequence(1, _ends div 2)")))  # ranges that repeat
    r = again.select("_range", "_low", "_high", F.explode(F.expr(f"sequence(_low div {per_cell * fan}, (_high - 1) div {per_cell * fan})")).alias("_wide"))
    cells = F.expr(f"sequence(greatest(_low div {per_cell}, _wide * {fan}), least((_high - 1) div {per_cell}, _wide * {fan} + {fan - 1}))")
    r = r.select("_range", "_low", "_high", F.explode(cells).alias("_cell"))
    at = placed.where(F.col("_what") == _POINT).select("_point", "_place", F.expr(f"_place div {per_cell}").alias("_cell"))
    return r.join(at, "_cell").where("_place >= _low AND _place < _high").select("_range.*", "_point.*")


def conflicts(reads: DataFrame, writes: DataFrame, per_cell: int = 64, fan: int = 16) -> DataFrame:
    """(tx, min, max, kind, key) where a transaction's read of a range [min, max) meets another's write: reads (tx, min,
    max), writes (tx, kind: put, remove or adjust, key). See within_ranges. Writes of one key and kind are one row before
    they meet reads, with the least and the greatest transaction, so that a hot key costs no more than another."""
    keys = writes.groupBy("kind", "key").agg(F.min("tx").alias("_first"), F.max("tx").alias("_last"))
    hit = within_ranges(keys, reads, per_cell, fan)
    return hit.where((F.col("tx") != F.col("_first")) | (F.col("tx") != F.col("_last"))).select("tx", "min", "max", "kind", "key").distinct()


def range_conflicts(reads: DataFrame, removes: DataFrame, per_cell: int = 64, fan: int = 16) -> DataFrame:
    """(tx, min, max, from, to) where a transaction's read of a range [min, max) meets another's removal of a range: removes
    (tx, from, to); from and to say what both have in common. Two ranges meet where one holds the other's lower end."""
    ends = removes.where(F.col("from") < F.col("to")).groupBy("from", "to").agg(F.min("tx").alias("_first"), F.max("tx").alias("_last"))
    begins = within_ranges(ends.withColumn("key", F.col("from")), reads, per_cell, fan)
    inside = within_ranges(reads.where("min < max").withColumn("key", F.col("min")).withColumnsRenamed({"min": "_min", "max": "_max"}), ends.withColumnsRenamed({"from": "min", "to": "max"}), per_cell, fan)
    inside = inside.withColumnsRenamed({"min": "from", "max": "to"}).withColumnsRenamed({"_min": "min", "_max": "max"}).where(F.col("from") < F.col("min"))
    names = ["tx", "min", "max", "from", "to", "_first", "_last"]
    both = begins.select(*names).unionByName(inside.select(*names)).where((F.col("tx") != F.col("_first")) | (F.col("tx") != F.col("_last")))
    return both.select("tx", "min", "max", F.greatest("min", "from").alias("from"), F.least("max", "to").alias("to")).distinct()


class Tracked:
    """A store that is read through, and remembers the ranges of keys that were read: for whole-number or binary keys."""

    def __init__(self, kv: DataFrame, by: str = "key"):
        self.kv, self.by, self.reads = kv, by, KeyRanges()

    def get(self, key: Any) -> DataFrame:
        self.reads = self.reads.union(KeyRanges([KeyRange(key, key + (b"\x00" if isinstance(key, bytes) else 1))]))
        return get(self.kv, key, self.by)

    def scan(self, ranges: KeyRange, reverse: bool = False) -> DataFrame:
        self.reads = self.reads.union(KeyRanges([ranges]))
        return scan(self.kv, ranges, reverse, self.by)


def watched(changes: DataFrame, watches: DataFrame, by: str = "key") -> DataFrame:
    """(watch, key) for watches (watch, key) of changed keys."""
    return watches.join(changes.select(by).distinct(), by, "left_semi")


def watched_ranges(changes: DataFrame, watches: DataFrame) -> DataFrame:
    """(watch, key) for watches (watch, min, max) of ranges of keys and the changed keys (key) in them."""
    return within_ranges(changes.select("key").distinct(), watches.select("watch", "min", "max")).select("watch", "key").distinct()


def union_of_stores(first: DataFrame, second: DataFrame, by: str = "key") -> DataFrame:
    """The entries of the first store, and those of the second whose keys it lacks: a fallback store merged."""
    return first.unionByName(second.join(first.select(by), by, "left_anti"))
