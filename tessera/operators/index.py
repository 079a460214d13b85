"""Index views: ordered values with the objects that hold them, over one to four value columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ordering import ascending, descending
from tessera.operators.bounds import Bounds, Values
from tessera.operators.model import Field, Snapshot


class IndexView:
    """A lazy view: value columns `values`, and the last column `target`. Each distinct tuple counts once; an object
    that holds the default, or null, has its entry like any other."""

    def __init__(self, entries: DataFrame, values: Sequence[str], target: str = "_id"):
        self.entries, self.values, self.target = entries, list(values), target

    def _with(self, entries: DataFrame) -> IndexView:
        return IndexView(entries, self.values, self.target)

    @property
    def columns(self) -> list[str]:
        return [*self.values, self.target]

    def as_set(self, descending_order: bool = False, ordered: bool = True) -> DataFrame:
        """All tuples, distinct, in order with null last."""
        out = self.entries.select(*self.columns).distinct()
        return out.orderBy(*(descending if descending_order else ascending)(*self.columns)) if ordered else out

    def as_map(self) -> DataFrame:
        """Each tuple of values with the sorted set of its targets, in one row. Of values that very many objects hold see
        summary, or pages."""
        return self.entries.groupBy(*self.values).agg(F.sort_array(F.collect_set(self.target)).alias("targets"))

    def pages(self, size: int = 1000) -> DataFrame:
        """as_map in rows of bounded size: each tuple of values with `page`, from 0, and up to about `size` of its targets, sorted.
        Targets go to pages by their hash, so that no task has all targets of a value."""
        entries = self.entries.select(*self.columns).distinct()
        counts = entries.groupBy(*self.values).agg((F.floor((F.count(self.target) - 1) / size) + 1).alias("_pages")).select(*[F.col(v).alias(f"_{v}") for v in self.values], "_pages")
        match = reduce(lambda a, b: a & b, [F.col(v).eqNullSafe(F.col(f"_{v}")) for v in self.values])
        paged = entries.join(counts, match).withColumn("page", F.pmod(F.xxhash64(self.target), F.col("_pages")))
        return paged.groupBy(*self.values, "page").agg(F.sort_array(F.collect_list(self.target)).alias("targets"))

    def summary(self) -> DataFrame:
        """Each tuple of values with the number, the least and the greatest of its targets: as_map without the sets, so
        that a value that most objects hold makes no large row."""
        return self.entries.select(*self.columns).distinct().groupBy(*self.values).agg(F.count(self.target).alias("n"), F.min(self.target).alias("first"), F.max(self.target).alias("last"))

    def get(self, *values: Any) -> DataFrame:
        """The targets of given values, for as many leading columns as are given; null matches null."""
        found = reduce(lambda e, vc: e.where(F.col(vc[1]).eqNullSafe(F.lit(vc[0]))), zip(values, self.values, strict=False), self.entries)
        return found.select(*self.values[len(values) :], self.target).distinct()

    def as_index(self, n: int) -> IndexView:
        """The view of the first n values; the one after them becomes the target. Tuples that fall together count once."""
        if not 1 <= n < len(self.values):
            raise ValueError(f"this view has prefixes of 1 to {len(self.values) - 1} values")
        kept = self.values[: n + 1]
        return IndexView(self.entries.select(*kept).distinct(), kept[:-1], kept[-1])

    def as_map_of_index(self, n: int) -> DataFrame:
        """Each tuple of the first n values with the number of distinct rows of the view below it: nested grouping."""
        rest = self.columns[n:]
        return self.entries.select(*self.columns).distinct().groupBy(*self.values[:n]).agg(F.count(F.struct(*rest)).alias("entries"))

    def nested(self, n: int) -> DataFrame:
        """as_map_of_index with the rows themselves, sorted."""
        return self.entries.select(*self.columns).distinct().groupBy(*self.values[:n]).agg(F.sort_array(F.collect_list(F.struct(*self.columns[n:]))).alias("entries"))

    def within(self, bounds: Bounds, value: int = 1) -> IndexView:
        """With a range on the value column number `value`, from 1."""
        if not 1 <= value <= len(self.values):
            raise ValueError(f"this view has values 1 to {len(self.values)}")
        return self._with(self.entries.where(bounds.predicate(F.col(self.values[value - 1]))))

    def within_target(self, bounds: Bounds) -> IndexView:
        return self._with(self.entries.where(bounds.predicate(F.col(self.target))))

    def matching(self, matcher: Values | Column, value: int = 1) -> IndexView:
        """With any filter on a value column."""
        p = matcher.predicate(F.col(self.values[value - 1])) if isinstance(matcher, Values) else matcher
        return self._with(self.entries.where(p))

    def mapped(self, **columns: Column) -> IndexView:
        """With values converted."""
        return self._with(self.entries.withColumns(columns))


def _fields(snapshot: Snapshot, type_name: str, name: str, part: str) -> list[tuple[str, Field]]:
    """The types under `type_name` that have the field, which must be indexed and of one kind in all of them."""
    found = [(t, snapshot.model.types[t].field(name)) for t in snapshot.model.subtypes(type_name) if snapshot.model.types[t].has(name)]
    if not found:
        raise KeyError(f"{type_name} has no field {name}")
    if len({f.kind for _, f in found}) > 1:
        raise ValueError(f"{type_name}.{name} is ambiguous: it has several kinds")
    for t, f in found:
        if not f.is_indexed(part):
            raise ValueError(f"{t}.{name}{'.' + part if part else ''} is not indexed")
    return found


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _plain(snapshot: Snapshot, t: str, f: Field, value: Column, more: Sequence[Column] = ()) -> DataFrame:
    return snapshot.of(t).select(value, "_id", *more)


def simple_index(snapshot: Snapshot, type_name: str, path: str) -> IndexView:
    """The index of a simple field, or of a part of a collection: "set.element", "map.key", "list.element", "map.value".
    The last two leave out the place in the list, or the key, so an object that holds a value twice counts once."""
    name, _, part = path.partition(".")
    parts = []
    for t, f in _fields(snapshot, type_name, name, part):
        c = F.col(f.col)
        if f.kind in ("set", "list"):
            if part != "element":
                raise ValueError(f"{path}: collections are indexed by part")
            value = F.explode(c)
        elif f.kind == "map":
            value = {"key": lambda: F.explode(F.map_keys(c)), "value": lambda: F.explode(F.map_values(c))}[part]()
        else:
            value = F.coalesce(c, F.lit(f.default)) if f.default is not None else c
        parts.append(_plain(snapshot, t, f, value.alias("value")))
    return IndexView(_union(parts), ["value"])


def list_index(snapshot: Snapshot, type_name: str, name: str) -> IndexView:
    """(value, _id) to places in the list, from 0."""
    parts = [snapshot.of(t).select("_id", F.posexplode(f.col).alias("index", "value")) for t, f in _fields(snapshot, type_name, name, "element")]
    return IndexView(_union(parts), ["value", "_id"], "index")


def map_value_index(snapshot: Snapshot, type_name: str, name: str) -> IndexView:
    """(value, _id) to keys of the map."""
    parts = [snapshot.of(t).select("_id", F.explode(f.col).alias("key", "value")) for t, f in _fields(snapshot, type_name, name, "value")]
    return IndexView(_union(parts), ["value", "_id"], "key")


def composite_index(snapshot: Snapshot, type_name: str, name: str) -> IndexView:
    """A composite index of two to four fields."""
    found = [t for t in snapshot.model.subtypes(type_name) if name in snapshot.model.types[t].composites]
    if not found:
        raise KeyError(f"{type_name} has no composite index {name}")
    names = snapshot.model.types[found[0]].composites[name]
    parts = []
    for t in found:
        kind = snapshot.model.types[t]
        parts.append(snapshot.of(t).select(*[F.col(kind.field(n).col).alias(n) for n in kind.composites[name]], "_id"))
    return IndexView(_union(parts), names)


def index_by_number(snapshot: Snapshot, number: int) -> IndexView:
    """The index of a storage number; see Model.storage_ids."""
    name = next((n for n, k in snapshot.model.storage_ids().items() if k == number), None)
    if name is None or "." not in name:
        raise KeyError(f"no index has the number {number}")
    t, _, path = name.partition(".")
    return composite_index(snapshot, t, path) if path in snapshot.model.types[t].composites else simple_index(snapshot, t, path)


def in_versions(view: IndexView, versions: DataFrame, *wanted: int) -> IndexView:
    """Only objects of the wanted schema versions; `versions` has (_id, _version)."""
    ids = versions.where(F.col("_version").isin(*wanted)).select("_id")
    return IndexView(view.entries.join(ids, "_id", "left_semi"), view.values, view.target)
