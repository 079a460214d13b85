"""Schema evolution: objects of one version of a type as objects of another."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.convert import upgraded
from tessera.operators.graph import cleared
from tessera.operators.model import Field, Model, ObjType


def migrate(rows: DataFrame, old: ObjType, new: ObjType, policies: dict[str, str] | None = None, on_change: Callable[[DataFrame], DataFrame] | None = None, kinds: dict[str, str] | None = None) -> DataFrame:
    """Objects of version `old` with the fields of `new`.

    A field of the same name and type keeps its value. One whose type changes is converted by its policy, RESET unless
    stated; `kinds` states new Spark types by field. A field that is new gets its default, one that is gone goes. A
    reference keeps its value where the types that it may refer to are the same or more. `on_change` gets the rows with
    the old fields as a struct _old beside the new ones, and returns rows.
    """
    policies, kinds, types = policies or {}, kinds or {}, dict(rows.dtypes)
    out = [F.col("_id"), F.lit(new.version).alias("_version")]
    if on_change is not None:
        out.append(F.struct(*rows.columns).alias("_old"))
    for f in new.fields:
        to = kinds.get(f.name) or (types.get(old.field(f.name).col) if old.has(f.name) else None) or "string"
        empty = F.lit(0 if f.kind == "counter" else f.default).cast(to if to != "char" else "string")
        if not old.has(f.name):
            out.append(empty.alias(f.col))
            continue
        was = old.field(f.name)
        c, source = F.col(was.col), types[was.col]
        collections = ("set", "list", "map")
        if was.kind != f.kind and (was.kind in collections or f.kind in collections or "ref" in (was.kind, f.kind)):
            out.append(empty.alias(f.col))
        elif source == to:
            out.append(c.alias(f.col))
        else:
            found = upgraded(c, source, to, policies.get(f.name, "RESET"), f.default)
            out.append((F.coalesce(found, empty) if f.kind == "counter" else found).alias(f.col))
    done = rows.select(*out)
    return done if on_change is None else on_change(done).drop("_old")


def without_removed_types(rows: DataFrame, field: str, model: Model, type_of: DataFrame, kept: tuple[str, ...]) -> DataFrame:
    """Rows whose reference `field` is null where it refers to an object of a type that is no longer allowed; `type_of`
    has (_id, _type)."""
    allowed = {t for name in kept for t in model.subtypes(name)}
    bad = type_of.where(~F.col("_type").isin(*allowed)).select(F.col("_id").alias("_bad"))
    return rows.join(bad, rows[field] == bad["_bad"], "left").withColumn(field, F.when(F.col("_bad").isNull(), F.col(field))).drop("_bad")


def without_removed_elements(rows: DataFrame, field: Field, part: str, model: Model, type_of: DataFrame, kept: tuple[str, ...]) -> DataFrame:
    """Rows whose collection `field` is without references, in its `part`, to objects of types that are no longer allowed."""
    allowed = {t for name in kept for t in model.subtypes(name)}
    gone = type_of.where(~F.col("_type").isin(*allowed)).select(F.col("_id").alias("_gone"))
    return cleared(rows, replace(field, on_delete="REMOVE"), part, gone)


class Schemas:
    """The models of all schema versions, by number."""

    def __init__(self, versions: Mapping[int, Model] | None = None):
        self.versions = dict(versions or {})

    def added(self, model: Model) -> tuple[Schemas, int]:
        """With a model, and its version: that of an equal model if there is one, or else the next."""
        if wrong := model.problems():
            raise ValueError("; ".join(wrong))
        for v, m in self.versions.items():
            if m.schema_id() == model.schema_id():
                return self, v
        v = max(self.versions, default=0) + 1
        return Schemas({**self.versions, v: model}), v

    def unused(self, objects: DataFrame) -> list[int]:
        """The versions that no object (_version) has."""
        used = {r[0] for r in objects.select("_version").distinct().collect()}  # as many as there are versions
        return [v for v in sorted(self.versions) if v not in used]

    def removed(self, version: int, objects: DataFrame) -> Schemas:
        """Without a version; an error if it isn't there, or an object has it."""
        if version not in self.versions:
            raise KeyError(f"no schema version {version}")
        if not objects.where(F.col("_version") == version).isEmpty():
            raise ValueError(f"schema version {version} has objects")
        return Schemas({v: m for v, m in self.versions.items() if v != version})

    def collected(self, objects: DataFrame) -> Schemas:
        """Without the versions that no object has."""
        unused = self.unused(objects)
        return Schemas({v: m for v, m in self.versions.items() if v not in unused})


def all_versions(*versions: DataFrame) -> DataFrame:
    """Objects of several versions together; fields that a version lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), versions)


def unused_versions(model_versions: DataFrame, objects: DataFrame) -> DataFrame:
    """(_version) that no object has."""
    return model_versions.select("_version").join(objects.select("_version"), "_version", "left_anti")
