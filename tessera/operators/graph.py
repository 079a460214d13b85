"""Cascades over references, copies of what they reach, and deletion with its actions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.lineage import cut
from tessera.operators.model import Field, Snapshot

KEY = ("_type", "_id")
#: Hops after which the nodes seen so far are written together again.
REWRITE = 8


def references(snapshot: Snapshot, wanted=lambda t, f: True) -> DataFrame:
    """All references as rows: _type and _id that hold one, field, part, to_type, to_id. Rows with `wanted` fields only.
    A reference of several possible types gives a row for each; whoever joins keeps the one that is there."""
    parts = []
    for t, frame in snapshot.frames.items():
        for f in snapshot.model.types[t].fields:
            for part, targets in f.refs.items():
                if not wanted(t, f):
                    continue
                c = F.col(f.col)
                value = c if not part else F.explode({"element": lambda c=c: c, "key": lambda c=c: F.map_keys(c), "value": lambda c=c: F.map_values(c)}[part]())
                held = frame.select("_id", value.alias("to_id")).where("to_id is not null").withColumn("to_id", F.col("to_id").cast("long"))
                for to in sorted({x for name in targets for x in snapshot.model.subtypes(name)}):
                    parts.append(held.select(F.lit(t).alias("_type"), F.col("_id").cast("long").alias("_id"), F.lit(f.name).alias("field"), F.lit(part).alias("part"), F.lit(to).alias("to_type"), "to_id"))
    if not parts:
        spark = next(iter(snapshot.frames.values())).sparkSession
        return spark.createDataFrame([], "_type string, _id long, field string, part string, to_type string, to_id long")
    return reduce(DataFrame.unionByName, parts)


def cascade_edges(snapshot: Snapshot, *names: str) -> DataFrame:
    """(src, dst), structs of _type and _id: along references that cascade under one of the names, and against those
    that cascade inversely."""
    node = lambda t, i: F.struct(F.col(t).alias("_type"), F.col(i).alias("_id"))
    along = references(snapshot, lambda t, f: f.cascades & set(names)).select(node("_type", "_id").alias("src"), node("to_type", "to_id").alias("dst"))
    against = references(snapshot, lambda t, f: f.inverse_cascades & set(names)).select(node("to_type", "to_id").alias("src"), node("_type", "_id").alias("dst"))
    return along.unionByName(against)


def cascade(edges: DataFrame, start: DataFrame, most: int = -1, visited: DataFrame | None = None) -> DataFrame:
    """(node, distance) of all nodes that the edges (src, dst) reach from `start` (node) in up to `most` hops, -1: any
    number; with the start itself, unless `visited` (node) has it.

    One join and one anti-join for each hop, over the nodes reached last, which are checkpointed; only whether any were
    new reaches the driver."""
    seen = start.select("node").distinct().withColumn("distance", F.lit(0))
    if visited is not None:
        seen = seen.join(visited.select("node"), "node", "left_anti")
    seen = frontier = cut(seen)
    hop = 0
    while most < 0 or hop < most:
        hop += 1
        new = edges.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        new = new.join(seen.select("node"), "node", "left_anti")
        if visited is not None:
            new = new.join(visited.select("node"), "node", "left_anti")
        frontier = cut(new.withColumn("distance", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        seen = cut(seen) if hop % REWRITE == 0 else seen
    return seen


def nodes(df: DataFrame) -> DataFrame:
    """(node) for rows of _type and _id."""
    return df.select(F.struct("_type", F.col("_id").cast("long").alias("_id")).alias("node"))


def copy_closure(snapshot: Snapshot, into: Snapshot, start: DataFrame, names: Iterable[str], most: int = -1) -> Snapshot:
    """`into` with the objects put in that the cascade reaches from `start` (_type, _id)."""
    reached = cascade(cascade_edges(snapshot, *names), nodes(start), most)
    for t in snapshot.frames:
        ids = reached.where(F.col("node._type") == t).select(F.col("node._id").alias("_id"))
        rows = snapshot.of(t).join(ids, "_id", "left_semi")
        into = into.upsert(t, rows) if t in into.frames else into.replaced(**{t: rows})
    return into


def with_new_ids(rows: DataFrame, refs: Iterable[str], ids: DataFrame) -> DataFrame:
    """Rows with their _id, and the columns `refs`, mapped by `ids` (old, new); ids that it lacks stay."""
    for c in ("_id", *refs):
        m = ids.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        rows = rows.join(m, rows[c] == m["_old"], "left").withColumn(c, F.coalesce("_new", c)).drop("_old", "_new")
    return rows


def dangling(snapshot: Snapshot, wanted=lambda t, f: True) -> DataFrame:
    """References, of `wanted` fields, to objects that are missing: _type, _id, field, part, to_id."""
    refs = references(snapshot, wanted)
    there = reduce(DataFrame.unionByName, [f.select(F.lit(t).alias("to_type"), F.col("_id").cast("long").alias("to_id"), F.lit(True).alias("there")) for t, f in snapshot.frames.items()])
    found = refs.join(there, ["to_type", "to_id"], "left").groupBy("_type", "_id", "field", "part", "to_id").agg(F.max("there").alias("there"))
    return found.where("there is null").drop("there")


@dataclass
class Deletion:
    """deleted (_type, _id), blockers (references that forbid it: _type, _id, field, to_type, to_id), after (snapshot)."""

    deleted: DataFrame
    blockers: DataFrame
    after: Snapshot

    def checked(self) -> Snapshot:
        """The snapshot after it; an error if something forbids it."""
        some = self.blockers.limit(5).collect()  # for the message
        if some:
            raise ValueError("objects are still referred to: " + "; ".join(f"{r['_type']} {r['_id']} {r['field']} -> {r['to_type']} {r['to_id']}" for r in some))
        return self.after


def delete(snapshot: Snapshot, start: DataFrame) -> Deletion:
    """Deletes the objects `start` (_type, _id), and what follows from that.

    Whoever refers to a deleted object under DELETE is deleted too, as is what a deleted object refers to under
    forward_delete. An object goes before those that its deletion brings about. EXCEPTION forbids it while another object
    that refers is still there, even one that would be deleted later, or as early; an object's reference to itself
    never does. NULLIFY makes the reference null (in a collection, a null element or value, once), REMOVE takes it out of
    its collection, IGNORE leaves it.
    """
    node = lambda t, i: F.struct(F.col(t).alias("_type"), F.col(i).alias("_id"))
    back = references(snapshot, lambda t, f: f.on_delete == "DELETE").select(node("to_type", "to_id").alias("src"), node("_type", "_id").alias("dst"))
    on = references(snapshot, lambda t, f: f.forward_delete).select(node("_type", "_id").alias("src"), node("to_type", "to_id").alias("dst"))
    reached = cascade(back.unionByName(on), nodes(start))
    timed = cut(reached.select("node._type", "node._id", "distance"))
    deleted = timed.drop("distance")
    gone = timed.withColumnsRenamed({"_type": "to_type", "_id": "to_id", "distance": "_then"})
    refs = references(snapshot, lambda t, f: f.on_delete == "EXCEPTION").where(~((F.col("_type") == F.col("to_type")) & (F.col("_id") == F.col("to_id"))))
    held = refs.join(gone, ["to_type", "to_id"]).join(timed, list(KEY), "left")
    blockers = held.where(F.col("distance").isNull() | (F.col("distance") >= F.col("_then"))).drop("distance", "_then")
    after = {}
    for t, frame in snapshot.frames.items():
        left = frame.join(deleted.where(F.col("_type") == t).select("_id"), "_id", "left_anti")
        for f in snapshot.model.types[t].fields:
            if f.on_delete in ("NULLIFY", "REMOVE"):
                for part, targets in f.refs.items():
                    types = sorted({x for name in targets for x in snapshot.model.subtypes(name)})
                    left = cleared(left, f, part, deleted.where(F.col("_type").isin(*types)).select(F.col("_id").alias("_gone")))
        after[t] = left
    return Deletion(deleted, blockers, snapshot.replaced(**after))


def cleared(frame: DataFrame, f: Field, part: str, gone: DataFrame) -> DataFrame:
    """Rows whose references to `gone` are nullified or removed: by a join on the references, so that neither side is
    sent around whole."""
    names = frame.columns
    if not part:
        return frame.join(gone, frame[f.col] == gone["_gone"], "left").withColumn(f.col, F.when(F.col("_gone").isNull(), F.col(f.col))).select(*names)
    c = F.col(f.col)
    value: Column = F.explode({"element": c, "key": F.map_keys(c), "value": F.map_values(c)}[part]) if f.kind == "map" else F.explode(c)
    hit = frame.select("_id", value.alias("_ref")).join(gone, F.col("_ref") == F.col("_gone")).groupBy("_id").agg(F.collect_set("_gone").alias("_hits"))
    out = frame.join(hit, "_id", "left").withColumn("_hits", F.coalesce("_hits", F.array().cast(hit.schema["_hits"].dataType)))
    dead = lambda x: F.array_contains("_hits", x)
    if f.kind == "map":
        if f.on_delete == "REMOVE":
            new = F.map_filter(c, lambda k, v: ~dead(k if part == "key" else v) | (F.lit(part == "value") & v.isNull()))
        elif part == "value":
            new = F.transform_values(c, lambda k, v: F.when(~dead(v), v))
        else:
            raise ValueError(f"{f.name}: a map in Spark has no null key; use REMOVE, or a table of entries")
    elif f.on_delete == "REMOVE":
        new = F.filter(c, lambda x: x.isNull() | ~dead(x))
    else:
        new = F.transform(c, lambda x: F.when(~dead(x), x))
        new = F.array_distinct(new) if f.kind == "set" else new
    return out.withColumn(f.col, F.when(F.size("_hits") > 0, new).otherwise(c)).select(*names)


def unreferenced(snapshot: Snapshot, name: str) -> DataFrame:
    """The objects of a type that nothing refers to (_id): what a collection of dependent objects deletes."""
    held = references(snapshot).where(F.col("to_type") == name).select(F.col("to_id").alias("_id"))
    return snapshot.of(name).select("_id").join(held, "_id", "left_anti")
