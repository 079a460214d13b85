"""Types of objects, their fields and indexes, and a snapshot: the objects themselves, one DataFrame for each type."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.bounds import OPEN, Bounds, Values

#: What becomes of a reference when the object that it refers to is deleted.
DELETE_ACTIONS = ("IGNORE", "EXCEPTION", "NULLIFY", "REMOVE", "DELETE")
KINDS = ("simple", "ref", "enum", "counter", "set", "list", "map")
MOST_INDEX_FIELDS = 4


@dataclass(frozen=True)
class Field:
    """A field. `column` holds it (by default its name); a set or list is an array, a map a map. `refs` names the types
    it may refer to, by part: "" for a ref, "element", "key" or "value" for collections; `indexed` names indexed parts
    likewise. References are always indexed."""

    name: str
    kind: str = "simple"
    column: str = ""
    default: Any = None
    indexed: frozenset[str] = frozenset()
    refs: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    unique: bool = False
    unique_excludes: Any = None
    on_delete: str = "EXCEPTION"
    forward_delete: bool = False
    cascades: frozenset[str] = frozenset()
    inverse_cascades: frozenset[str] = frozenset()
    names: tuple[str, ...] = ()
    allow_deleted: bool = False

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"{self.name}: no such kind of field: {self.kind}")
        if self.on_delete not in DELETE_ACTIONS:
            raise ValueError(f"{self.name}: no such delete action: {self.on_delete}")
        if self.on_delete == "REMOVE" and self.kind not in ("set", "list", "map"):
            raise ValueError(f"{self.name}: REMOVE is for collections only")
        if self.unique and "" not in self.indexed:
            raise ValueError(f"{self.name}: unique fields must be indexed")

    @property
    def col(self) -> str:
        return self.column or self.name

    def is_indexed(self, part: str = "") -> bool:
        return part in self.indexed or part in self.refs


def ref(name: str, *targets: str, column: str = "", **more: Any) -> Field:
    return Field(name, "ref", column, refs={"": tuple(targets)}, **more)


@dataclass(frozen=True)
class ObjType:
    """A type: its name, the interfaces that it has, its fields, composite indexes (2 to 4 simple fields), composite
    uniqueness, and whether it has one object at most."""

    name: str
    fields: tuple[Field, ...]
    interfaces: tuple[str, ...] = ()
    composites: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    unique_composites: Mapping[str, tuple[tuple[Any, ...], ...]] = field(default_factory=dict)
    singleton: bool = False
    version: int = 1

    def __post_init__(self) -> None:
        by_name = {f.name: f for f in self.fields}
        for name, parts in self.composites.items():
            if not 2 <= len(parts) <= MOST_INDEX_FIELDS:
                raise ValueError(f"{self.name}.{name}: a composite index has 2 to {MOST_INDEX_FIELDS} fields")
            for p in parts:
                if p not in by_name or by_name[p].kind in ("set", "list", "map", "counter"):
                    raise ValueError(f"{self.name}.{name}: {p} can't be in a composite index")

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(f"{self.name} has no field {name}")

    def has(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)


def _said(x: Any) -> Any:
    """A value, or a matcher of values, as JSON can hold it."""
    if isinstance(x, Values):
        return {"nulls": x.nulls, "non_nulls": x.non_nulls, "literals": list(x.literals), "ranges": [_said(r) for r in x.ranges]}
    if isinstance(x, Bounds):
        ends = {k: v for k, v in (("lower", x.lower), ("upper", x.upper)) if v is not OPEN}
        return ends | {"lower_in": x.lower_in, "upper_in": x.upper_in}
    return x


def _meant(x: Any) -> Any:
    if isinstance(x, dict):
        return Values(x["nulls"], x["non_nulls"], tuple(x["literals"]), tuple(Bounds(**r) for r in x["ranges"]))
    return x


def object_key(number: Column | int, id_: Column) -> Column:
    """The binary key of an object: the number of its type in 2 bytes, and its id in 8, so that keys order by both."""
    of = lambda c, n: F.lpad(F.hex(c if isinstance(c, Column) else F.lit(c)), n, "0")
    return F.unhex(F.concat(of(number, 4), of(id_.cast("long"), 16)))


class Model:
    """All types, with their interfaces."""

    def __init__(self, types: Iterable[ObjType]):
        self.types = {t.name: t for t in types}

    def subtypes(self, name: str | None = None) -> list[str]:
        """The types that are, or have, `name`; all for None or "object"."""
        if name in (None, "object"):
            return sorted(self.types)
        found = sorted(t.name for t in self.types.values() if name == t.name or name in t.interfaces)
        if not found:
            raise KeyError(f"no such type: {name}")
        return found

    def schema_id(self) -> str:
        """A hash of all that the model says, but for the order of its types and fields; equal models have equal ids."""
        said = json.loads(self.to_json())
        for t in said:
            t["fields"].sort(key=lambda f: f["name"])
        return hashlib.sha256(json.dumps(sorted(said, key=lambda t: t["name"]), sort_keys=True).encode()).hexdigest()[:32]

    def to_json(self) -> str:
        """All types, with all that is stated of them."""
        plain = lambda f: {"name": f.name, "kind": f.kind, "column": f.column, "default": f.default, "indexed": sorted(f.indexed), "refs": {k: list(v) for k, v in f.refs.items()}, "unique": f.unique, "unique_excludes": _said(f.unique_excludes), "on_delete": f.on_delete, "forward_delete": f.forward_delete, "cascades": sorted(f.cascades), "inverse_cascades": sorted(f.inverse_cascades), "names": list(f.names), "allow_deleted": f.allow_deleted}
        types = [{"name": t.name, "interfaces": list(t.interfaces), "fields": [plain(f) for f in t.fields], "composites": {k: list(v) for k, v in t.composites.items()}, "unique_composites": {k: [[_said(x) for x in row] for row in v] for k, v in t.unique_composites.items()}, "singleton": t.singleton, "version": t.version} for t in self.types.values()]
        return json.dumps(types, indent=1)

    @staticmethod
    def from_json(text: str) -> Model:
        made = []
        for t in json.loads(text):
            fields = tuple(Field(**{**f, "indexed": frozenset(f["indexed"]), "refs": {k: tuple(v) for k, v in f["refs"].items()}, "unique_excludes": _meant(f["unique_excludes"]), "cascades": frozenset(f["cascades"]), "inverse_cascades": frozenset(f["inverse_cascades"]), "names": tuple(f["names"])}) for f in t["fields"])
            composites = {k: tuple(v) for k, v in t["composites"].items()}
            unique = {k: tuple(tuple(_meant(x) for x in row) for row in v) for k, v in t["unique_composites"].items()}
            made.append(ObjType(t["name"], fields, tuple(t["interfaces"]), composites, unique, t["singleton"], t["version"]))
        return Model(made)

    def problems(self) -> list[str]:
        """What is wrong with the model as a whole, as lines: references to types that aren't there, fields named twice,
        uniqueness of composite indexes that aren't there, and indexed fields of one name that types of one interface have
        as different kinds."""
        out, known = [], {*self.types, *(i for t in self.types.values() for i in t.interfaces), "object"}
        kinds: dict[tuple[str, str], set[str]] = {}
        for t in self.types.values():
            names = [f.name for f in t.fields]
            out += [f"{t.name}.{n} is there twice" for n in sorted({n for n in names if names.count(n) > 1})]
            out += [f"{t.name}.{f.name} refers to {to}, which is no type" for f in t.fields for ts in f.refs.values() for to in ts if to not in known]
            out += [f"{t.name} has no composite index {c}" for c in t.unique_composites if c not in t.composites]
            for f in t.fields:
                for i in (*t.interfaces, t.name) if f.indexed or f.refs else ():
                    kinds.setdefault((i, f.name), set()).add(f.kind)
        return out + [f"{i}.{f} has several kinds" for (i, f), k in sorted(kinds.items()) if len(k) > 1]

    def storage_ids(self) -> dict[str, int]:
        """A number from 1 for each type, indexed field (Type.field, or with its part) and composite index (Type.index)."""
        names = []
        for t in sorted(self.types):
            names.append(t)
            for f in self.types[t].fields:
                names += [f"{t}.{f.name}" + (f".{part}" if part else "") for part in sorted({*f.indexed, *f.refs})]
            names += [f"{t}.{c}" for c in sorted(self.types[t].composites)]
        return {n: k for k, n in enumerate(names, 1)}

    def key_ranges(self, name: str | None = None) -> list[tuple[bytes, bytes]]:
        """The ranges [low, high) of the keys (see object_key) of all objects that are, or have, the type `name`."""
        ids = self.storage_ids()
        return sorted((ids[t].to_bytes(2, "big"), (ids[t] + 1).to_bytes(2, "big")) for t in self.subtypes(name))

    def differences(self, other: Model) -> list[str]:
        """What `other` has that differs, as lines."""
        out = []
        for name in sorted({*self.types, *other.types}):
            a, b = self.types.get(name), other.types.get(name)
            if a is None or b is None:
                out.append(f"{'+' if a is None else '-'} type {name}")
                continue
            for f in sorted({x.name for x in (*a.fields, *b.fields)}):
                if not a.has(f) or not b.has(f):
                    out.append(f"{'+' if not a.has(f) else '-'} {name}.{f}")
                elif a.field(f) != b.field(f):
                    out.append(f"~ {name}.{f}")
            if dict(a.composites) != dict(b.composites):
                out.append(f"~ {name} composite indexes")
        return out


class Frames(Mapping):
    """DataFrames by type; a function of no arguments in the place of one is called when it is first asked for, so that
    only the tables that a query touches are opened."""

    def __init__(self, made: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self._made = dict(made)

    def __getitem__(self, name: str) -> DataFrame:
        found = self._made[name]
        if not isinstance(found, DataFrame):
            found = self._made[name] = found()
        return found

    def __iter__(self) -> Iterator[str]:
        return iter(self._made)

    def __len__(self) -> int:
        return len(self._made)

    def replaced(self, frames: Mapping[str, DataFrame]) -> Frames:
        return Frames({**self._made, **frames})


class Snapshot:
    """Objects at one time: for each type a DataFrame with _id and its columns. Writes give a new snapshot. Ids are whole numbers
    for cascades, deletion and keys; extents, indexes and paths take ids of any type."""

    def __init__(self, model: Model, frames: Mapping[str, DataFrame]):
        self.model, self.frames = model, frames if isinstance(frames, Frames) else Frames(frames)

    def of(self, name: str) -> DataFrame:
        return self.frames[name]

    def extent(self, name: str | None = None, columns: Iterable[str] = ()) -> DataFrame:
        """(_type, _id) and the stated columns of all objects that are, or have, the type `name`."""
        wanted = list(columns)
        parts = []
        for t in self.model.subtypes(name):
            if t in self.frames:
                f = self.frames[t]
                parts.append(f.select(F.lit(t).alias("_type"), "_id", *[c for c in wanted if c in f.columns]))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def get(self, name: str, ids: DataFrame | Iterable[Any]) -> DataFrame:
        """The objects of the type with the given ids: a DataFrame with _id, or a few values."""
        if isinstance(ids, DataFrame):
            return self.frames[name].join(ids.select("_id"), "_id", "left_semi")
        return self.frames[name].where(F.col("_id").isin(*ids))

    def exists(self, name: str, ids: DataFrame) -> DataFrame:
        """(_id, found) for each given id."""
        there = self.frames[name].select("_id", F.lit(True).alias("found"))
        return ids.select("_id").distinct().join(there, "_id", "left").select("_id", F.coalesce("found", F.lit(False)).alias("found"))

    def read(self, name: str, *fields: str) -> DataFrame:
        """_id and the stated fields, with their defaults where they hold nothing."""
        out = []
        for n in fields:
            f = self.model.types[name].field(n)
            c = F.col(f.col)
            default = 0 if f.kind == "counter" else f.default
            out.append((F.coalesce(c, F.lit(default)) if default is not None else c).alias(n))
        return self.frames[name].select("_id", *out)

    def singleton(self, name: str) -> DataFrame:
        """The first object of a type."""
        return self.frames[name].orderBy("_id").limit(1)

    def singleton_or_new(self, name: str, _id: Any = 1) -> Snapshot:
        """With one object of a type put in, with its defaults, if there is none; see singleton."""
        return self if not self.frames[name].isEmpty() else self.created(name, self.frames[name].sparkSession.createDataFrame([(_id,)], "_id long"))

    def created(self, name: str, ids: DataFrame) -> Snapshot:
        """With an object for each of the given _ids that has none, with the defaults of its fields: what creates objects
        under ids of one's own, and those that were deleted again. Objects that are there stay as they are."""
        old, kind = self.frames[name], self.model.types[name]
        new = ids.select(F.col("_id").cast(old.schema["_id"].dataType).alias("_id")).distinct().join(old.select("_id"), "_id", "left_anti")
        given = {f.col: F.lit(0 if f.kind == "counter" else f.default) for f in kind.fields}
        empty = {"set": F.array(), "list": F.array(), "map": F.create_map()}
        given |= {f.col: empty[f.kind] for f in kind.fields if f.kind in empty}
        rows = new.select("_id", *[given.get(c.name, F.lit(None)).cast(c.dataType).alias(c.name) for c in old.schema if c.name != "_id"])
        return self.replaced(**{name: old.unionByName(rows)})

    def cleared(self) -> Snapshot:
        """With the same types and no objects."""
        return Snapshot(self.model, {t: f.limit(0) for t, f in self.frames.items()})

    def by_key(self, name: str | None = None) -> DataFrame:
        """(key, _type, _id) of all objects that are, or have, the type `name`; see object_key and Model.key_ranges."""
        ids = self.model.storage_ids()
        parts = [f.select(object_key(ids[t], F.col("_id")).alias("key"), F.lit(t).alias("_type"), F.col("_id").cast("long").alias("_id")) for t in self.model.subtypes(name) if (f := self.frames.get(t)) is not None]
        return reduce(DataFrame.unionByName, parts)

    def by_version(self) -> DataFrame:
        """(_version, _type, objects): how many objects each schema version of each type has."""
        parts = [f.select(F.lit(t).alias("_type"), F.col("_version") if "_version" in f.columns else F.lit(self.model.types[t].version).alias("_version")) for t, f in self.frames.items()]
        return reduce(DataFrame.unionByName, parts).groupBy("_version", "_type").agg(F.count("*").alias("objects"))

    def replaced(self, **frames: DataFrame) -> Snapshot:
        return Snapshot(self.model, self.frames.replaced(frames))

    def upsert(self, name: str, rows: DataFrame) -> Snapshot:
        """With rows put in, in place of those with the same _id."""
        old = self.frames[name]
        return self.replaced(**{name: old.join(rows.select("_id"), "_id", "left_anti").unionByName(rows, allowMissingColumns=True)})

    def adjusted(self, name: str, counter: str, deltas: DataFrame) -> Snapshot:
        """With (_id, delta) added to a counter; several deltas of one object add up."""
        c = self.model.types[name].field(counter).col
        total = deltas.groupBy("_id").agg(F.sum("delta").alias("_delta"))
        new = self.frames[name].join(total, "_id", "left").withColumn(c, F.coalesce(c, F.lit(0)).cast("long") + F.coalesce("_delta", F.lit(0))).drop("_delta")
        return self.replaced(**{name: new})
