"""Reference paths: steps along references and against them, through several types.

A path is a sequence of steps. "->field" or "->Type.field" goes along a reference, "<-Type.field" against one, to the
objects of the type that refer here. A field in a collection is named with its part: "->list.element",
"<-Type.map.value". Results are distinct; null references lead nowhere; a reference to a missing object is still a
result, but nothing lies beyond it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.model import Field, Model, Snapshot

_STEP = re.compile(r"(->|<-)([\w.]+)")
_PARTS = ("element", "key", "value")


@dataclass(frozen=True)
class Step:
    forward: bool
    #: The types that the step starts from or leads to whose field it uses: the types that hold the reference.
    holders: tuple[str, ...]
    field: str
    part: str
    #: The types that can be current after it.
    types: tuple[str, ...]


@dataclass(frozen=True)
class Path:
    starts: tuple[str, ...]
    steps: tuple[Step, ...]

    @property
    def targets(self) -> tuple[str, ...]:
        return self.steps[-1].types if self.steps else self.starts

    @property
    def type_lists(self) -> list[tuple[str, ...]]:
        return [self.starts, *(s.types for s in self.steps)]

    @property
    def fields(self) -> list[str]:
        return [s.field for s in self.steps]

    def is_singular(self) -> bool:
        """Whether an object has one result at most."""
        return all(s.forward and not s.part for s in self.steps)


def _targets(model: Model, f: Field, part: str) -> set[str]:
    out: set[str] = set()
    for t in f.refs.get(part, ()):
        out.update(model.subtypes(t))
    return out


def parse(model: Model, start: str, text: str) -> Path:
    """The path from objects that are, or have, the type `start`. Types that can't take a step drop out; if none is
    left, it is an error."""
    if "".join(m[0] for m in _STEP.finditer(text)) != text:
        raise ValueError(f"not a path: {text!r}")
    current = starts = tuple(model.subtypes(start))
    steps = []
    for arrow, name in _STEP.findall(text):
        words = name.split(".")
        part = words.pop() if len(words) > 1 and words[-1] in _PARTS else ""
        if arrow == "->":
            field = words[-1]
            named = set(model.subtypes(words[0])) if len(words) == 2 else set(model.types)
            holders = tuple(t for t in current if t in named and model.types[t].has(field) and part in model.types[t].field(field).refs)
            types = set().union(*(_targets(model, model.types[t].field(field), part) for t in holders)) if holders else set()
        else:
            if len(words) != 2:
                raise ValueError(f"a step against a reference needs its type: <-Type.{name}")
            field = words[1]
            holders = tuple(t for t in model.subtypes(words[0]) if model.types[t].has(field) and part in model.types[t].field(field).refs and _targets(model, model.types[t].field(field), part) & set(current))
            types = set(holders)
        if not types:
            raise ValueError(f"no object can take the step {arrow}{name} from {', '.join(current)}")
        current = tuple(sorted(types))
        steps.append(Step(arrow == "->", holders, field, part, current))
    return Path(starts, tuple(steps))


def _values(f: Field, part: str) -> Column:
    c = F.col(f.col)
    if not part:
        return c
    return F.explode({"element": c, "key": F.map_keys(c), "value": F.map_values(c)}[part])


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def saved(model: Model, start: str, text: str):
    """The path as a query: a function of a snapshot and of objects, of the type `start`, that gives what it leads to."""
    path = parse(model, start, text)
    return lambda snapshot, objects: follow(snapshot, path, objects)


def follow_pairs(snapshot: Snapshot, path: Path, start: DataFrame) -> DataFrame:
    """(_start, _type, _id): what the path leads to from each of the objects `start` (_id), which have one type; each pair once."""
    if len(path.starts) != 1:
        raise ValueError("pairs are of paths from one type")
    now = start.select(F.col("_id").alias("_start"), F.lit(path.starts[0]).alias("_type"), "_id").distinct()
    for s in path.steps:
        parts = []
        for t in s.holders:
            f, frame = snapshot.model.types[t].field(s.field), snapshot.of(t)
            targets = _targets(snapshot.model, f, s.part)
            held = frame.select(F.col("_id").alias("_held"), _values(f, s.part).alias("_ref")).where("_ref is not null")
            if s.forward:
                found = now.where(F.col("_type") == t).join(held, F.col("_id") == F.col("_held")).select("_start", F.col("_ref").alias("_id"))
                for to in s.types:
                    if to in targets:
                        own = found if len(s.types) == 1 else found.join(snapshot.of(to).select("_id"), "_id", "left_semi")
                        parts.append(own.select("_start", F.lit(to).alias("_type"), "_id"))
            else:
                here = now.where(F.col("_type").isin(*targets)).select("_start", F.col("_id").alias("_to"))
                parts.append(held.join(here, F.col("_ref") == F.col("_to")).select("_start", F.lit(t).alias("_type"), F.col("_held").alias("_id")))
        now = _union(parts).distinct()
    return now


def follow(snapshot: Snapshot, path: Path, start: DataFrame, strict: bool = False) -> DataFrame:
    """(_type, _id) of what the path leads to from the objects `start` (_type, _id), or _id if they have one type. strict: a step
    along a reference from an object that isn't there ends the query, in place of leading nowhere."""
    if "_type" not in start.columns:
        if len(path.starts) != 1:
            raise ValueError("objects of several types need the column _type")
        start = start.select(F.lit(path.starts[0]).alias("_type"), "_id")
    now = start.select("_type", "_id").where(F.col("_type").isin(*path.starts))
    if not path.steps:
        return now.distinct()
    for s in path.steps:
        parts = []
        for t in s.holders:
            f, frame = snapshot.model.types[t].field(s.field), snapshot.of(t)
            if s.forward:
                here = now.where(F.col("_type") == t).select("_id")
                if strict:
                    there = here.join(frame.select("_id", F.lit(True).alias("_there")), "_id", "left")
                    gone = F.raise_error(F.concat(F.lit(f"{t} is deleted: "), F.col("_id").cast("string"))).cast("boolean")
                    here = there.where(F.coalesce("_there", gone)).select("_id")
                found = frame.join(here, "_id", "left_semi").select(_values(f, s.part).alias("_id")).where("_id is not null")
                for to in s.types:
                    if to in _targets(snapshot.model, f, s.part):
                        # one possible type: the reference says it all; several: the one that has the object
                        own = found if len(s.types) == 1 else found.join(snapshot.of(to).select("_id"), "_id", "left_semi")
                        parts.append(own.select(F.lit(to).alias("_type"), "_id"))
            else:
                targets = _targets(snapshot.model, f, s.part)
                here = now.where(F.col("_type").isin(*targets)).select(F.col("_id").alias("_to"))
                held = frame.select("_id", _values(f, s.part).alias("_ref"))
                parts.append(held.join(here, F.col("_ref") == F.col("_to"), "left_semi").select(F.lit(t).alias("_type"), "_id"))
        now = _union(parts)
        if s.forward or s.part:  # a step against a plain reference gives each holder once, as ids are unique
            now = now.distinct()
    return now


def invert(model: Model, path: Path) -> Path:
    """The path that leads back."""
    lists = path.type_lists
    steps = []
    for i in range(len(path.steps) - 1, -1, -1):
        s = path.steps[i]
        steps.append(Step(not s.forward, s.holders, s.field, s.part, tuple(t for t in lists[i] if not s.forward or t in s.holders)))
    return Path(path.targets, tuple(steps))


def follow_back(snapshot: Snapshot, path: Path, targets: DataFrame) -> DataFrame:
    """(_type, _id) of the objects from which the path leads to one of the targets."""
    return follow(snapshot, invert(snapshot.model, path), targets)
