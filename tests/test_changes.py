"""Constraints, evolution, changes, keys and values, consistency, sources and streams."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.operators import changes as ch
from tessera.operators import consistency, constraints, evolve, kv, paths
from tessera.operators.bounds import Bounds, Values
from tessera.operators.index import simple_index
from tessera.operators.model import Field, Model, ObjType, Snapshot, ref
from tessera.sources import entries, objects
from tessera.streaming import feed

IDX = frozenset({""})


def rows(df, *names):
    return sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=str)


@pytest.fixture(scope="module")
def named(spark):
    model = Model([ObjType("A", (Field("name", indexed=IDX, unique=True, unique_excludes=Values(literals=("frob",))), Field("v", indexed=IDX)), composites={"nv": ("name", "v")}, unique_composites={"nv": ()}), ObjType("B", (ref("a", "A"),), singleton=True)])
    data = [(1, "x", 1.0), (2, "x", 2.0), (3, "frob", 3.0), (4, "frob", 3.0), (5, None, float("nan")), (6, None, float("nan"))]
    return Snapshot(model, {"A": spark.createDataFrame(data, "_id long, name string, v double"), "B": spark.createDataFrame([(1, 1), (2, 2)], "_id long, a long")})


def test_uniqueness(named):
    assert rows(constraints.unique_field(named, "A", "name", Values(literals=("frob",))), "value", "objects") == [("x", [1, 2]), (None, [5, 6])]
    assert rows(constraints.unique_field(named, "A", "v", Values(nulls=True)), "n") == [(2,), (2,)]
    assert rows(constraints.unique_composite(named, "A", "nv"), "objects") == [([3, 4],), ([5, 6],)]
    assert rows(constraints.unique_composite(named, "A", "nv", [("frob", Values(ranges=(Bounds.ge(3.0),)))]), "objects") == [([5, 6],)]


def test_at_most_five_are_named(spark):
    s = Snapshot(Model([ObjType("A", (Field("n", indexed=IDX),))]), {"A": spark.range(40).select(F.col("id").alias("_id"), F.lit(1).alias("n"))})
    assert rows(constraints.unique_field(s, "A", "n"), "n", "objects") == [(40, [0, 1, 2, 3, 4])]


def test_validation(named, spark):
    found = constraints.validate(named, [constraints.Rule("A", "low", F.col("v") < 3, early=True), constraints.Rule("A", "named", F.col("name").isNotNull(), frozenset({"other"}))])
    got = rows(found)
    assert (2, "B", None, "singleton") in got and (1, "A", "3", "low") in got and (3, "A", "1", "unique name") in got and not any(r[3] == "named" for r in got)
    touched = {"A": spark.createDataFrame([(5,)], "_id long")}
    assert [r for r in rows(constraints.validate(named, [constraints.Rule("A", "named", F.col("name").isNotNull())], touched=touched)) if r[0] == 4] == [(4, "A", "5", "named")]


def test_stated_rules(spark):
    s = Snapshot(Model([ObjType("A", ())]), {"A": spark.createDataFrame([(1, 5, "ab", [1]), (2, 50, "x", [1, 2, 3]), (3, None, None, None)], "_id long, n int, s string, l array<int>")})
    rules = [constraints.not_null("A", "n"), constraints.within("A", "n", Values(ranges=(Bounds(0, 10),))), constraints.matches("A", "s", "^..$"), constraints.sized("A", "l", 1, 2)]
    assert rows(constraints.validate(s, rules), "_id", "rule") == [("2", "l has a wrong size"), ("2", "n is out of range"), ("2", "s is malformed"), ("3", "n is missing")]


def test_migration(spark):
    old = ObjType("A", (Field("a"), Field("b"), Field("n", "counter"), Field("gone"), ref("r", "A")))
    new = ObjType("A", (Field("a", default=7), Field("b"), Field("n"), Field("extra", default="e"), Field("r")), version=2)
    df = spark.createDataFrame([(1, "12", "t", 5, "z", 9), (2, "q", None, None, "z", None)], "_id long, a string, b string, n long, gone string, r long")
    got = rows(evolve.migrate(df, old, new, {"a": "ATTEMPT"}, kinds={"a": "int", "extra": "string"}))
    assert got == [(1, 2, 12, "t", 5, "e", None), (2, 2, 7, None, None, "e", None)]
    called = evolve.migrate(df, old, new, {"a": "ATTEMPT"}, lambda d: d.withColumn("extra", F.col("_old.gone")), kinds={"a": "int", "extra": "string"})
    assert rows(called, "extra") == [("z",), ("z",)]
    assert evolve.all_versions(df.select("_id", "a"), df.select("_id", "b")).columns == ["_id", "a", "b"]
    versions = spark.createDataFrame([(1,), (2,)], "_version int")
    assert rows(evolve.unused_versions(versions, spark.createDataFrame([(2,)], "_version int"))) == [(1,)]


def test_schema_ids_and_differences():
    a, b = Model([ObjType("A", (Field("x"),))]), Model([ObjType("A", (Field("x", indexed=IDX), Field("y"))), ObjType("B", ())])
    assert a.schema_id() == Model([ObjType("A", (Field("x"),))]).schema_id() != b.schema_id()
    assert Model.from_json(b.to_json()).schema_id() == b.schema_id() and Model.from_json(b.to_json()).differences(b) == []
    assert a.differences(b) == ["~ A.x", "+ A.y", "+ type B"] and a.differences(a) == []


def test_diff_and_replay(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3)], "_id long, s string, n int")
    new = spark.createDataFrame([(1, "a", 2), (2, None, None), (4, "d", 4)], "_id long, s string, n int")
    assert rows(ch.diff(old, new, ["s", "n"])) == sorted([("change", 1, "n", "1", "2"), ("change", 2, "s", "b", None), ("create", 4, None, None, None), ("delete", 3, None, None, None)], key=str)
    e = lambda x: spark.createDataFrame(x, "_id long, element string")
    assert rows(ch.diff_elements(e([(1, "a"), (1, "b")]), e([(1, "b"), (1, "c")]), "tags")) == [("add tags", 1, "c"), ("remove tags", 1, "a")]
    log = spark.createDataFrame([(1, "change", 1, "z"), (2, "delete", 2, None), (3, "create", 9, "n"), (4, "change", 1, "y"), (5, "change", 3, None)], "seq int, op string, _id long, value string")
    assert rows(ch.replay(old, log, "s")) == [(1, "y"), (3, None), (9, "n")]


def test_listeners_hear_once(spark):
    model = Model([ObjType("P", (Field("name"), Field("known", "list", refs={"element": ("P",)})))])
    s = Snapshot(model, {"P": spark.createDataFrame([(1, "a", [2, 3]), (2, "b", [3]), (3, "c", [])], "_id long, name string, known array<long>")})
    changed = spark.createDataFrame([("P", 3), ("P", 2)], "_type string, _id long")
    assert rows(ch.concerned(s, paths.parse(model, "P", "->known.element"), changed)) == [("P", 1), ("P", 2)]


def test_moments_follow_changes(spark):
    rng = random.Random(2)
    data = [(rng.choice("ab"), rng.gauss(5, 3), rng.random() < 0.4) for _ in range(200)] + [("one", 4.0, False), ("none", 1.0, True)]
    df = spark.createDataFrame(data, "k string, v double, gone boolean")
    m = lambda d: ch.moments(d, ["k"], F.col("v"))
    both = ch.combined(m(df.where("v < 5")), m(df.where("v >= 5")), ["k"])
    left = {r.k: r for r in ch.variance(ch.combined(both, m(df.where("gone")), ["k"], -1), ["k"]).collect()}
    for k in "ab":
        vs = [v for a, v, g in data if a == k and not g]
        assert left[k].n == len(vs) and abs(left[k].mean - statistics.fmean(vs)) < 1e-9 and abs(left[k].variance - statistics.pvariance(vs)) < 1e-9
    assert (left["one"].n, left["one"].variance, left["none"].n, left["none"].variance) == (1, 0.0, 0, 0.0)


def test_overlays_equal_a_model(spark):
    rng = random.Random(9)
    base = {k: rng.randrange(100) for k in rng.sample(range(60), 30)}
    removed, puts, span = rng.sample(range(60), 10), {k: rng.randrange(100) for k in rng.sample(range(60), 10)}, (20, 30)
    adjusts = [(rng.randrange(60), rng.randrange(-5, 6)) for _ in range(40)]
    want = {k: v for k, v in base.items() if k not in removed and not span[0] <= k < span[1]} | puts
    for k, d in adjusts:
        if k in want:
            want[k] += d
    f = lambda x, s: spark.createDataFrame(x, s)
    got = kv.overlay(f(list(base.items()), "key int, value long"), f([(k,) for k in removed], "key int"), f(list(puts.items()), "key int, value long"), f(adjusts, "key int, delta int"), kv.KeyRanges([kv.KeyRange(*span)]))
    assert dict(rows(got)) == want
    assert rows(kv.at_least(f(list(base.items()), "key int, value long"), 10), "key") == [(min(k for k in base if k >= 10),)]
    assert rows(kv.at_most(f(list(base.items()), "key int, value long"), 10), "key") == [(max(k for k in base if k < 10),)]


def test_conflicts_equal_a_model(spark):
    rng = random.Random(4)
    reads = [(rng.randrange(5), lo := rng.randrange(100), lo + rng.randrange(20)) for _ in range(40)]
    writes = [(rng.randrange(5), rng.choice(["put", "remove", "adjust"]), rng.randrange(100)) for _ in range(60)]
    want = {(t, lo, hi, k, key) for t, lo, hi in reads for by, k, key in writes if by != t and lo <= key < hi}
    r, w = spark.createDataFrame(reads, "tx int, min long, max long"), spark.createDataFrame(writes, "tx int, kind string, key long")
    assert set(rows(kv.conflicts(r, w))) == want and set(rows(kv.conflicts(r, w, per_cell=1, fan=2))) == want
    assert kv.conflicts(r, w.limit(0)).isEmpty() and kv.conflicts(r.limit(0), w).isEmpty()


def test_ranges_merge(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 7, 9), ("a", 2, 4), ("b", 1, 2)], "g string, min int, max int")
    assert rows(kv.coalesced(df, ["g"])) == [("a", 1, 5), ("a", 7, 9), ("b", 1, 2)]
    a, b = spark.createDataFrame([(1, 1)], "key int, value int"), spark.createDataFrame([(1, 9), (2, 2)], "key int, value int")
    assert rows(kv.union_of_stores(a, b)) == [(1, 1), (2, 2)]


def test_consistency(named):
    view = simple_index(named, "A", "name")
    stored = view.entries.where("_id <> 5").unionByName(view.entries.where("_id = 1").withColumn("value", F.lit("old")))
    assert rows(consistency.report(view, stored)) == [("missing", None, 5), ("orphan", "old", 1)]
    assert rows(consistency.repaired(view, stored)) == rows(view.as_set()) and consistency.report(view, view.entries).isEmpty()
    assert rows(consistency.malformed(named.of("A").unionByName(named.of("A").where("_id = 1")), ["name"])) == [(1, "repeated id"), (5, "no name"), (6, "no name")]


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "xml"])
def test_objects_round_trip(spark, tmp_path, format):
    model = Model([ObjType("A", (Field("n", default=5), Field("s")))])
    s = Snapshot(model, {"A": spark.createDataFrame([(1, 5, "x"), (2, 6, "é"), (3, 5, "y")], "_id long, n int, s string")})
    objects.save(s, f"file://{tmp_path}/o", format, omit_defaults=True)
    back = objects.load(spark, model, f"file://{tmp_path}/o", {"A": s.of("A").schema}, format)
    assert rows(back.read("A", "n", "s")) == [(1, 5, "x"), (2, 6, "é"), (3, 5, "y")]
    with pytest.raises(ValueError):
        objects.save(s, f"file://{tmp_path}/o", "nope")


def test_imports(spark):
    df = objects.import_plain(spark, [{"label": "a", "to": "b"}, {"label": "b", "to": "zz"}], "label string, to string")
    made, ids = objects.assign_ids(df, "label")
    got = {r.label: r for r in objects.resolve(made, "to", ids, "label").collect()}
    assert got["a"].to == got["b"]._id and got["b"].to is None
    with pytest.raises(ValueError):
        objects.assign_ids(df, "label", ids)
    assert objects.dump(spark.createDataFrame([([1, 2, 3],)], "a array<int>"), 2).first().a == [1, 2]


def test_entries_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(b"\x01", b"v"), (b"\x00\xff", b""), (b"b", b"\x00")], "key binary, value binary")
    plain = lambda d: sorted((bytes(r.key), bytes(r.value)) for r in d.collect())
    entries.write_sorted(df, f"file://{tmp_path}/s", 2)
    entries.write_xml(df, f"file://{tmp_path}/x")
    assert plain(entries.read_sorted(spark, f"file://{tmp_path}/s")) == plain(entries.read_xml(spark, f"file://{tmp_path}/x")) == plain(df)


def drained(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return rows(stream.sparkSession.table(name))


def test_streams(spark, tmp_path):
    data = [(1, "a", "2024-01-01 00:00:10", 1.0), (2, "a", "2024-01-01 00:00:50", 3.0), (3, "b", "2024-01-01 00:03:00", 5.0), (1, "a", "2024-01-01 00:00:10", 1.0)]
    df = spark.createDataFrame(data, "seq long, k string, at string, v double").withColumn("at", F.col("at").cast("timestamp"))
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = lambda: feed.changes_from(spark, f"file://{tmp_path}/in", df.schema)
    assert drained(feed.counters(stream(), ["k"], "v"), "counters", "complete") == [("a", 5.0), ("b", 5.0)]
    assert drained(feed.maintained(stream(), ["k"], F.col("v")), "maintained", "complete")[1] == ("b", 1, 5.0, 0.0)
    assert [r[2:] for r in drained(feed.windowed(stream(), "at", "1 minute", "10 minutes", ["k"]), "windowed", "complete")] == [("a", 3), ("b", 1)]
    assert len(drained(feed.first_seen(stream(), "seq", "at", "1 hour"), "first_seen", "append")) == 3
    watches = spark.createDataFrame([("w", "b")], "watch string, k string")
    assert [r[-1] for r in drained(feed.watched(stream(), watches, "k"), "watched", "append")] == ["w"]
    seen = []
    feed.each_batch(stream(), lambda b, n: seen.append(b.count()), f"file://{tmp_path}/ck").awaitTermination()
    assert sum(seen) == 4
