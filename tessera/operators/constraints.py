"""Uniqueness, singletons, and validation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.bounds import Values
from tessera.operators.graph import dangling
from tessera.operators.index import IndexView, composite_index, simple_index
from tessera.operators.model import Snapshot

#: Objects that a report of a conflict names at most.
MOST_NAMED = 5


def unique_violations(view: IndexView, excludes: Column | None = None) -> DataFrame:
    """Values of an index that several objects hold: the value columns, n, and up to MOST_NAMED of the objects. Null is
    a value like any other, unless excluded. Counts come before names, which are gathered for the conflicts only."""
    entries = view.entries.select(*view.values, view.target).distinct()
    entries = entries if excludes is None else entries.where(~F.coalesce(excludes, F.lit(False)))
    taken = entries.groupBy(*view.values).agg(F.count(view.target).alias("n")).where("n > 1")
    match = reduce(lambda a, b: a & b, [F.col(f"e.{v}").eqNullSafe(F.col(f"t.{v}")) for v in view.values])
    named = entries.alias("e").join(taken.alias("t"), match).select(*[F.col(f"t.{v}").alias(v) for v in view.values], "n", F.col(f"e.{view.target}").alias("_id"))
    ranked = named.withColumn("_n", F.row_number().over(W.partitionBy(*view.values).orderBy("_id"))).where(F.col("_n") <= MOST_NAMED)
    return ranked.groupBy(*view.values, "n").agg(F.sort_array(F.collect_list("_id")).alias("objects"))


def unique_field(snapshot: Snapshot, type_name: str, name: str, excludes: Values | None = None) -> DataFrame:
    """Conflicts of a unique simple field, over all types that share it under `type_name`."""
    return unique_violations(simple_index(snapshot, type_name, name), None if excludes is None else excludes.predicate(F.col("value")))


def unique_composite(snapshot: Snapshot, type_name: str, name: str, excludes: Iterable[Sequence[Any]] = ()) -> DataFrame:
    """Conflicts of a unique composite index; values are excluded that equal all fields of an excluded row. An excluded
    row may hold matchers in place of values."""
    view = composite_index(snapshot, type_name, name)
    rows = [reduce(lambda a, b: a & b, [x.predicate(F.col(v)) if isinstance(x, Values) else F.col(v).eqNullSafe(F.lit(x)) for v, x in zip(view.values, row, strict=True)]) for row in excludes]
    return unique_violations(view, reduce(lambda a, b: a | b, rows) if rows else None)


def singleton_violations(snapshot: Snapshot) -> DataFrame:
    """(_type, n) of types with more objects than the one that they may have."""
    parts = [snapshot.of(t).agg(F.lit(t).alias("_type"), F.count("*").alias("n")) for t, kind in snapshot.model.types.items() if kind.singleton and t in snapshot.frames]
    if not parts:
        return next(iter(snapshot.frames.values())).sparkSession.createDataFrame([], "_type string, n long")
    return reduce(DataFrame.unionByName, parts).select(F.col("_type"), "n").where("n > 1")


def reference_violations(snapshot: Snapshot) -> DataFrame:
    """(_type, _id, field, part, to_id, problem) of references that may not be: "type" if an object with that id is there
    but of no type that the field may refer to, "deleted" if there is none and the field doesn't allow that."""
    found = dangling(snapshot)
    there = reduce(DataFrame.unionByName, [f.select(F.col("_id").cast("long").alias("_there")) for f in snapshot.frames.values()]).distinct()
    held = found.join(there, F.col("to_id") == F.col("_there"), "left")
    strict = [F.struct(F.lit(t), F.lit(f.name)) for t, kind in snapshot.model.types.items() for f in kind.fields if f.refs and not f.allow_deleted]
    is_strict = F.struct("_type", "field").isin(*strict) if strict else F.lit(False)
    problem = F.when(F.col("_there").isNotNull(), "type").when(is_strict, "deleted")
    return held.withColumn("problem", problem).where("problem is not null").drop("_there")


@dataclass(frozen=True)
class Rule:
    """A condition that objects of a type must meet. groups: when it counts; early: before the other checks; stated: one that
    is stated of a field, and comes before uniqueness."""

    type_name: str
    name: str
    holds: Column | Callable[[DataFrame], DataFrame]
    groups: frozenset[str] = frozenset({"default"})
    early: bool = False
    stated: bool = False


def not_null(type_name: str, field: str, **more: Any) -> Rule:
    return Rule(type_name, f"{field} is missing", F.col(field).isNotNull(), stated=True, **more)


def within(type_name: str, field: str, values: Values, **more: Any) -> Rule:
    """Null passes, as it does for other rules; see not_null."""
    return Rule(type_name, f"{field} is out of range", F.col(field).isNull() | values.predicate(F.col(field)), stated=True, **more)


def matches(type_name: str, field: str, pattern: str, **more: Any) -> Rule:
    return Rule(type_name, f"{field} is malformed", F.col(field).rlike(pattern), stated=True, **more)


def sized(type_name: str, field: str, low: int, high: int, **more: Any) -> Rule:
    """A collection of low to high elements."""
    return Rule(type_name, f"{field} has a wrong size", F.size(field).between(low, high) | F.col(field).isNull(), stated=True, **more)


def validate(snapshot: Snapshot, rules: Sequence[Rule], groups: Iterable[str] = ("default",), touched: Mapping[str, DataFrame] | None = None, references: bool = False, steps: bool = False) -> DataFrame:
    """(phase, _type, _id, rule) of what fails. phase: 1 early rules, 2 singletons, 3 unique fields and composites, 4 other
    rules. With `steps` also step, the place of the check: 1 early rules, 2 singletons, 3 rules stated of fields and references, 4 uniqueness,
    5 other rules. A condition that is null holds. With `touched` (a DataFrame of _id by type) rules are checked for those
    objects only. `references`: whether references are checked too, as phase 4."""
    wanted, parts = set(groups), []
    for r in rules:
        if not r.groups & wanted:
            continue
        for t in snapshot.model.subtypes(r.type_name):
            if touched is not None and t not in touched:
                continue
            rows = snapshot.of(t) if touched is None else snapshot.of(t).join(touched[t].select("_id"), "_id", "left_semi")
            failed = r.holds(rows) if callable(r.holds) else rows.where(~F.coalesce(r.holds, F.lit(True)))
            parts.append(failed.select(F.lit(1 if r.early else 4).alias("phase"), F.lit(1 if r.early else 3 if r.stated else 5).alias("step"), F.lit(t).alias("_type"), F.col("_id").cast("string").alias("_id"), F.lit(r.name).alias("rule")))
    parts.append(singleton_violations(snapshot).select(F.lit(2).alias("phase"), F.lit(2).alias("step"), "_type", F.lit(None).cast("string").alias("_id"), F.lit("singleton").alias("rule")))
    for t, kind in snapshot.model.types.items():
        if t not in snapshot.frames:
            continue
        for f in kind.fields:
            if f.unique:
                parts.append(_named(unique_field(snapshot, t, f.name, f.unique_excludes), t, f"unique {f.name}"))
        for name, excludes in kind.unique_composites.items():
            parts.append(_named(unique_composite(snapshot, t, name, excludes), t, f"unique {name}"))
    if references:
        parts.append(reference_violations(snapshot).select(F.lit(4).alias("phase"), F.lit(3).alias("step"), "_type", F.col("_id").cast("string").alias("_id"), F.concat_ws(" ", F.lit("reference"), "field", "problem").alias("rule")))
    found = reduce(DataFrame.unionByName, parts)
    return found if steps else found.drop("step")


def _named(found: DataFrame, t: str, rule: str) -> DataFrame:
    return found.select(F.explode("objects").alias("_id")).select(F.lit(3).alias("phase"), F.lit(4).alias("step"), F.lit(t).alias("_type"), F.col("_id").cast("string").alias("_id"), F.lit(rule).alias("rule"))
