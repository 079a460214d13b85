"""Changes between snapshots: finding them, replaying them, telling who is concerned, and sums kept up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.lineage import spread
from tessera.operators.model import Snapshot
from tessera.operators.paths import Path, follow_back, follow_pairs, invert

#: Kinds of changes.
CREATE, DELETE, CHANGE = "create", "delete", "change"

#: Entries of a map up to which a key is looked for in all of them.
FEW_ENTRIES = 32


def diff(old: DataFrame, new: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(op, _id, field, old, new) between two states of one type, values as text: created and deleted objects with the
    field null, and a row for each field whose value differs, null from null not. By one full join."""
    a = old.select("_id", F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("a"), F.lit(True).alias("_a"))
    b = new.select("_id", F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("b"), F.lit(True).alias("_b"))
    both = a.join(b, "_id", "full")
    rows = [F.struct(F.lit(CHANGE).alias("op"), F.lit(f).alias("field"), F.col(f"a.{f}").alias("old"), F.col(f"b.{f}").alias("new"), (F.col("_a") & F.col("_b") & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias("is")) for f in fields]
    none = F.lit(None).cast("string")
    rows += [F.struct(F.lit(op).alias("op"), none.alias("field"), none.alias("old"), none.alias("new"), F.col(there).isNull().alias("is")) for op, there in ((CREATE, "_a"), (DELETE, "_b"))]
    return both.select("_id", F.explode(F.array(*rows)).alias("c")).where("c.is").select("c.op", "_id", "c.field", "c.old", "c.new")


def diff_elements(old: DataFrame, new: DataFrame, field: str, keys: Sequence[str] = ("_id", "element")) -> DataFrame:
    """(op, keys...) of elements added to and removed from a set field; `old` and `new` have the exploded elements, which may
    repeat. By one grouping."""
    both = old.select(*keys, F.lit(1).alias("_side")).unionByName(new.select(*keys, F.lit(2).alias("_side")))
    both = spread(both, *keys).groupBy(*keys).agg(F.bit_or("_side").alias("_side"))
    return both.where("_side < 3").select(F.when(F.col("_side") == 2, f"add {field}").otherwise(f"remove {field}").alias("op"), *keys)


def diff_lists(old: DataFrame, new: DataFrame, field: str) -> DataFrame:
    """(_id, op, at, old, new) between two states of a list field: replace, add and remove at places from 0, place by place, or clear
    of a list that is empty now. Adds come in the order of their places; removes are from the end. Null counts as empty."""
    a = old.select("_id", F.col(field).alias("_a"))
    both = a.join(new.select("_id", F.col(field).alias("_b")), "_id")
    none = F.array().cast(a.schema["_a"].dataType)
    both = both.withColumns({"_a": F.coalesce("_a", none), "_b": F.coalesce("_b", none)})
    places = F.sequence(F.lit(0), F.greatest(F.size("_a"), F.size("_b")) - 1)
    events = F.transform(places, lambda i: F.struct(F.when(i >= F.size("_a"), "add").when(i >= F.size("_b"), "remove").when(~F.get("_a", i).eqNullSafe(F.get("_b", i)), "replace").alias("op"), i.alias("at"), F.get("_a", i).alias("old"), F.get("_b", i).alias("new")))
    cleared = F.array(F.struct(F.lit("clear").alias("op"), F.lit(None).cast("int").alias("at"), F.lit(None).cast(a.schema["_a"].dataType.elementType).alias("old"), F.lit(None).cast(a.schema["_a"].dataType.elementType).alias("new")))
    found = F.when(F.size("_a") + F.size("_b") == 0, F.slice(cleared, 1, 0)).when(F.size("_b") == 0, cleared).otherwise(F.filter(events, lambda e: e["op"].isNotNull()))
    return both.select("_id", F.explode(found).alias("e")).select("_id", "e.op", "e.at", "e.old", "e.new")


def diff_maps(old: DataFrame, new: DataFrame, field: str) -> DataFrame:
    """(_id, op, key, old, new) between two states of a map field: add, remove and replace of entries, or clear of a map that is
    empty now. By one join of the objects; entries of equal maps, and of one map that is empty, meet no others. Null counts as
    empty. Of the others those with few entries are compared within their row, those with many by a grouping of the entries."""
    kind = old.schema[field].dataType
    a, b = F.col("_a"), F.col("_b")
    none = F.create_map().cast(kind)
    both = old.select("_id", F.coalesce(field, none).alias("_a")).join(new.select("_id", F.coalesce(F.col(field).cast(kind), none).alias("_b")), "_id")
    both = both.where((F.size(a) > 0) | (F.size(b) > 0))

    def event(op: str, key: Column, before: Column, after: Column) -> Column:
        return F.struct(F.lit(op).alias("op"), key.cast(kind.keyType).alias("key"), before.cast(kind.valueType).alias("old"), after.cast(kind.valueType).alias("new"))

    null = F.lit(None)
    gone = F.transform(F.map_entries(a), lambda e: F.when(~F.map_contains_key(b, e["key"]), event("remove", e["key"], e["value"], null)).when(~F.try_element_at(b, e["key"]).eqNullSafe(e["value"]), event("replace", e["key"], e["value"], F.try_element_at(b, e["key"]))))
    come = F.transform(F.map_entries(b), lambda e: F.when(~F.map_contains_key(a, e["key"]), event("add", e["key"], null, e["value"])))
    few = F.greatest(F.size(a), F.size(b)) <= FEW_ENTRIES
    events = F.when(F.size(b) == 0, F.array(event("clear", null, null, null))).when(few, F.filter(F.concat(gone, come), lambda e: e.isNotNull()))
    near = both.where((F.size(b) == 0) | few).select("_id", F.explode(events).alias("e")).select("_id", "e.op", "e.key", "e.old", "e.new")
    many = both.where((F.size(b) > 0) & ~few)
    entries = many.select("_id", F.explode(a).alias("key", "_v"), F.lit(1).alias("_side")).unionByName(many.select("_id", F.explode(b).alias("key", "_v"), F.lit(2).alias("_side")))
    value = lambda side: F.first(F.when(F.col("_side") == side, F.struct("_v")), ignorenulls=True)
    met = entries.groupBy("_id", "key").agg(value(1).alias("_old"), value(2).alias("_new"))
    op = F.when(F.col("_old").isNull(), "add").when(F.col("_new").isNull(), "remove").when(~F.col("_old._v").eqNullSafe(F.col("_new._v")), "replace")
    far = met.withColumn("op", op).where("op is not null").select("_id", "op", "key", F.col("_old._v").alias("old"), F.col("_new._v").alias("new"))
    return near.unionByName(far)


def replay_elements(base: DataFrame, changes: DataFrame, keys: Sequence[str] = ("_id", "element"), value: str | None = None) -> DataFrame:
    """The elements of a set field, or with `value` the entries of a map field, after changes (seq, op: add, remove, replace or
    clear, keys..., value): of each element the last change counts, if none of the object's clears came after it."""
    owner, more = keys[0], [value] if value else []
    start = base.select(F.lit(None).cast("long").alias("seq"), F.lit("add").alias("op"), *keys, *more)
    last = start.unionByName(changes.where("op <> 'clear'").select(F.col("seq").cast("long").alias("seq"), "op", *keys, *more))
    last = spread(last, *keys).groupBy(*keys).agg(F.max(F.struct(F.coalesce("seq", F.lit(-(2**63))).alias("seq"), "op", *more)).alias("end"))
    clears = changes.where("op = 'clear'").groupBy(F.col(owner).alias("_of")).agg(F.max("seq").alias("_cleared"))
    kept = last.join(clears, F.col(owner) == F.col("_of"), "left").where("end.op <> 'remove' AND (_cleared IS NULL OR end.seq > _cleared)")
    return kept.select(*keys, *[F.col(f"end.{v}").alias(v) for v in more])


def replay_lists(base: DataFrame, changes: DataFrame, field: str) -> DataFrame:
    """`base` (_id, field) after changes (seq, op: add, remove, replace or clear, _id, at, new) of a list field. Places shift as
    changes are made, so those of one object are made one after the other, in one row."""
    steps = changes.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("seq", "op", "at", "new"))).alias("_steps"))
    kind = base.schema[field].dataType
    held = base.join(steps, "_id", "left").withColumn("_list", F.coalesce(field, F.array().cast(kind)))

    def made(held: Column, e: Column) -> Column:
        head = lambda n: F.slice(held, F.lit(1), n)
        tail = lambda n: F.slice(held, n + 1, F.greatest(F.size(held) - n, F.lit(0)))
        put = F.array(e["new"])
        return F.when(e["op"] == "clear", F.slice(held, 1, 0)).when(e["op"] == "add", F.concat(head(e["at"]), put, tail(e["at"]))).when(e["op"] == "replace", F.concat(head(e["at"]), put, tail(e["at"] + 1))).otherwise(F.concat(head(e["at"]), tail(e["at"] + 1)))

    after = F.when(F.col("_steps").isNull(), F.col(field)).otherwise(F.aggregate("_steps", F.col("_list"), made))
    return held.select("_id", after.alias(field))


def replay(base: DataFrame, changes: DataFrame, field: str) -> DataFrame:
    """`base` (_id, field) after changes (seq, op, _id, value): of each object the last one counts. A created object that
    base lacks appears, a deleted one goes."""
    end = changes.groupBy("_id").agg(F.max_by(F.struct("op", "value"), "seq").alias("end"))
    both = base.withColumn("_there", F.lit(True)).join(end, "_id", "full")
    alive = F.when(F.col("end").isNull(), F.lit(True)).otherwise(F.col("end.op") != DELETE)
    return both.where(alive).select("_id", F.when(F.col("end").isNotNull(), F.col("end.value")).otherwise(F.col(field)).alias(field))


def last_writes(changes: DataFrame, key: str, value: str, seq: Sequence[str]) -> DataFrame:
    """(key, value) of the last change of each key."""
    return changes.groupBy(key).agg(F.max_by(value, F.struct(*seq)).alias(value))


def in_order(changes: DataFrame, *fields: str) -> DataFrame:
    """Changes in the order of delivery: by field, then object."""
    return changes.orderBy(*fields, "_id")


def concerned(snapshot: Snapshot, path: Path, changed: DataFrame) -> DataFrame:
    """(_type, _id) of the objects from which the path leads to a changed object: who is told, each once."""
    return follow_back(snapshot, path, changed)


def notices(snapshot: Snapshot, paths: dict[str, Path], changed: DataFrame) -> DataFrame:
    """(listener, _type, _id) for listeners by name, each with its path."""
    out = None
    for name, path in sorted(paths.items()):
        told = concerned(snapshot, path, changed).select(F.lit(name).alias("listener"), "_type", "_id")
        out = told if out is None else out.unionByName(told)
    return out


def told(snapshot: Snapshot, paths: dict[str, Path], changes: DataFrame) -> DataFrame:
    """(listener, _type, _id, ...) for listeners by name, each with its path, and changes (_id, ...) with what they say, such as op,
    field, old and new: a row for each change that a listening object is told of. `_id` is the object's that listens, `changed`
    that which the change is of."""
    out = None
    names = [c for c in changes.columns if c != "_id"]
    for name, path in sorted(paths.items()):
        start = changes.select("_id").distinct()
        pairs = follow_pairs(snapshot, invert(snapshot.model, path), start)
        heard = pairs.join(changes.withColumnRenamed("_id", "_start"), "_start").select(F.lit(name).alias("listener"), "_type", "_id", F.col("_start").alias("changed"), *names)
        out = heard if out is None else out.unionByName(heard)
    return out


def before_deletion(snapshot: Snapshot, paths: dict[str, Path], deleted: DataFrame) -> DataFrame:
    """(listener, _type, _id) of who is told that objects (_id) are deleted: by paths through the snapshot that still has them."""
    return notices(snapshot, paths, deleted)


# Sums kept up to date: count, mean and M2, the sum of squared distances from the mean.


def moments(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """(keys, n, mean, m2)."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def combined(a: DataFrame, b: DataFrame, keys: Sequence[str], sign: int = 1) -> DataFrame:
    """Moments of all rows of a and b, or for sign -1 of a without b."""
    x = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in ("n", "mean", "m2")])
    y = b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in ("n", "mean", "m2")])
    both = x.join(y, list(keys), "full").na.fill(0)
    na, nb = F.col("_a_n"), F.col("_b_n") * sign
    n = na + nb
    mean = F.when(n > 0, (na * F.col("_a_mean") + nb * F.col("_b_mean")) / F.when(n > 0, n))
    if sign > 0:
        m2 = F.col("_a_m2") + F.col("_b_m2") + F.when(n > 0, (F.col("_b_mean") - F.col("_a_mean")) ** 2 * na * nb / F.when(n > 0, n)).otherwise(0.0)
    else:
        m2 = F.col("_a_m2") - F.col("_b_m2") - F.when(n > 0, (F.col("_b_mean") - mean) ** 2 * F.col("_b_n") * n / F.when(na > 0, na)).otherwise(0.0)
    return both.select(*keys, n.alias("n"), mean.alias("mean"), F.greatest(m2, F.lit(0.0)).alias("m2"))


def variance(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, mean, variance) of the population; 0 for one row or none."""
    return m.select(*keys, "n", "mean", F.when(F.col("n") <= 1, F.lit(0.0)).otherwise(F.col("m2") / F.col("n")).alias("variance"))


def neighbours(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows with the value of `order` before and after theirs."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumns({"before": F.lag(order).over(w), "after": F.lead(order).over(w)})
