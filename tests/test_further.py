"""Ranges, conflicts, schemas and events against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.ranges import Cells
from tessera.operators import changes as ch
from tessera.operators import evolve, graph, kv, navigate, paths
from tessera.operators.bounds import Bounds, Values
from tessera.operators.model import Field, Model, ObjType, Snapshot, ref

IDX = frozenset({""})


def test_cells_rise_with_values_and_hold_about_equally_many(spark, monkeypatch):
    import tessera.functions.ranges as ranges

    monkeypatch.setattr(ranges, "MOST_CELLS", 8)  # so that there are two levels
    rng = random.Random(1)
    values = [rng.expovariate(1) ** 6 for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = Cells.of(df, 3000, 60).put(df, F.col("v"), "cell").collect()
    cells = [r["cell"] for r in sorted(got, key=lambda r: r["v"])]
    counts = [cells.count(c) for c in set(cells)]
    assert cells == sorted(cells) and len(counts) > 30 and max(counts) < 200


def test_merged_ranges_equal_a_model(spark):
    rng = random.Random(2)
    for per_cell in (5, 1000):
        rows = [(rng.choice("ab"), m := rng.randrange(500) ** 2, m + rng.randrange(1, 3000)) for _ in range(200)] + [("a", 5, 200_000)]
        df = spark.createDataFrame(rows, "g string, min long, max long")
        for by in ((), ("g",)):
            want = []
            for g in "ab" if by else " ":
                at = []
                for _, lo, hi in sorted((r for r in rows if not by or r[0] == g), key=lambda r: r[1:]):
                    if at and lo <= at[-1][1]:
                        at[-1][1] = max(at[-1][1], hi)
                    else:
                        at.append([lo, hi])
                want += [(*([g] if by else []), *x) for x in at]
            assert sorted(tuple(r) for r in kv.coalesced(df, by, per_cell).collect()) == sorted(want)


def test_conflicts_equal_a_model_for_skewed_and_binary_keys(spark):
    rng = random.Random(3)
    key = lambda: rng.choice([7, 7, 7, rng.randrange(50), rng.randrange(100_000)])
    reads = [(t, m := key(), m + rng.choice([1, 5, 40_000])) for t in range(60)]
    writes = [(rng.randrange(60), rng.choice(["put", "remove"]), key()) for _ in range(300)]
    removes = [(rng.randrange(60), m := key(), m + rng.choice([1, 9, 30_000])) for _ in range(80)]
    want = {(t, a, b, k, x) for t, a, b in reads for u, k, x in writes if t != u and a <= x < b}
    cut = {(t, a, b, max(a, x), min(b, y)) for t, a, b in reads for u, x, y in removes if t != u and a < y and x < b}
    r = spark.createDataFrame(reads, "tx int, min long, max long")
    w = spark.createDataFrame(writes, "tx int, kind string, key long")
    m = spark.createDataFrame(removes, "tx int, from long, to long")
    for per_cell in (4, 64):
        assert {tuple(x) for x in kv.conflicts(r, w, per_cell, 2).collect()} == want
        assert {tuple(x) for x in kv.range_conflicts(r, m, per_cell, 2).collect()} == cut
    raw = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    got = kv.conflicts(r.select("tx", raw("min").alias("min"), raw("max").alias("max")), w.withColumn("key", raw("key")), 4)
    assert {(x["tx"], *(int.from_bytes(x[c], "big") for c in ("min", "max")), x["kind"], int.from_bytes(x["key"], "big")) for x in got.collect()} == want


def test_seeking_keys():
    r = kv.KeyRanges([kv.KeyRange(10, 20), kv.KeyRange(30, None)])
    assert [r.seek_higher(k) for k in (5, 10, 19, 20, 99)] == [10, 10, 19, 30, 99]
    assert [r.seek_lower(k) for k in (5, 10, 15, 25, 30, 50)] == [None, None, 15, 20, 20, 50]
    assert r.find(12) == kv.KeyRange(10, 20) and r.find(25) is None
    one = kv.KeyRange(b"a", b"a\x00")
    assert one.is_single() and [one.compare(k) for k in (b"A", b"a", b"b")] == [1, 0, -1] and not kv.KeyRange(b"a", b"b").is_single()


def test_numbered_rows_are_in_order(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, *range(9)])) for i in range(200)]
    got = navigate.numbered(spark.createDataFrame(rows, "i int, v int"), F.col("v"), F.col("i"), partitions=5).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert [r["i"] for r in sorted(got, key=lambda r: r["place"])] == [i for i, _ in want] and sorted(r["place"] for r in got) == [*range(1, 201)]


def test_a_model_comes_back_from_json():
    out = Values(True, False, (1, 2), (Bounds(3, 9, False, True), Bounds.ge(20)))
    model = Model([ObjType("A", (Field("n", indexed=IDX, unique=True, unique_excludes=out), Field("m"), ref("r", "A", allow_deleted=True)), ("I",), {"nm": ("n", "m")}, {"nm": ((1, "x"), (out, None))}, True, 3)])
    back = Model.from_json(model.to_json())
    assert back.types == model.types and back.schema_id() == model.schema_id() and not model.problems()
    other = Model([ObjType("A", (Field("n", indexed=IDX, default=5),))])
    assert other.schema_id() != Model([ObjType("A", (Field("n", indexed=IDX),))]).schema_id()
    bad = Model([ObjType("A", (ref("r", "Missing"), Field("x", indexed=IDX), Field("x")), ("I",), {}, {"none": ()}), ObjType("B", (Field("x", "list", indexed=frozenset({"element"})),), ("I",))])
    assert len(bad.problems()) == 4


def test_schemas(spark):
    schemas, first = evolve.Schemas().added(Model([ObjType("A", (Field("x"),))]))
    schemas, second = schemas.added(Model([ObjType("A", (Field("x"), Field("y")))]))
    objects = spark.createDataFrame([(1, 2)], "_id long, _version int")
    assert (first, second) == (1, 2) and schemas.unused(objects) == [1] and sorted(schemas.removed(1, objects).versions) == [2]
    with pytest.raises(ValueError):
        schemas.removed(2, objects)
    with pytest.raises(KeyError):
        schemas.removed(9, objects)
    with pytest.raises(ValueError):
        schemas.added(Model([ObjType("A", (ref("r", "None"),))]))


def test_strict_paths_end_at_deleted_objects(spark):
    model = Model([ObjType("N", (ref("next", "N"),))])
    s = Snapshot(model, {"N": spark.createDataFrame([(1, 2), (2, 3), (4, None)], "_id long, next long")})
    p = paths.parse(model, "N", "->next->next")
    assert paths.follow(s, p, spark.createDataFrame([(1,)], "_id long"), strict=True).collect()[0]["_id"] == 3
    far = paths.parse(model, "N", "->next->next->next")
    assert paths.follow(s, far, spark.createDataFrame([(1,)], "_id long")).count() == 0
    with pytest.raises(Exception, match="deleted"):
        paths.follow(s, far, spark.createDataFrame([(1,)], "_id long"), strict=True).collect()


def test_exception_blocks_while_a_holder_is_there(spark):
    """1 is deleted first, and with it 2, which refers to it under DELETE; 3 refers to 2 and stays, 4 refers to itself."""
    kind = ObjType("N", (ref("up", "N", on_delete="DELETE"), ref("held", "N", on_delete="EXCEPTION")))
    rows = spark.createDataFrame([(1, None, None), (2, 1, 1), (3, None, 2), (4, None, 4), (5, 4, None), (6, 5, 5)], "_id long, up long, held long")
    s = Snapshot(Model([kind]), {"N": rows})
    start = lambda i: spark.createDataFrame([("N", i)], "_type string, _id long")
    assert {(r["_id"], r["to_id"]) for r in graph.delete(s, start(1)).blockers.collect()} == {(2, 1), (3, 2)}
    assert {(r["_id"], r["to_id"]) for r in graph.delete(s, start(4)).blockers.collect()} == {(6, 5)}


def test_lists_and_maps_come_back_by_replaying_their_events(spark):
    rng = random.Random(5)
    draw = lambda: [rng.randrange(4) for _ in range(rng.randrange(6))]
    rows = [(i, draw(), draw()) for i in range(60)]
    old, new = (spark.createDataFrame([(r[0], r[k]) for r in rows], "_id long, v array<int>") for k in (1, 2))
    events = ch.diff_lists(old, new, "v").withColumn("seq", F.when(F.col("op") == "remove", -F.col("at")).otherwise(F.col("at")))
    assert {r["_id"]: r["v"] for r in ch.replay_lists(old, events, "v").collect()} == {r[0]: r[2] for r in rows}
    maps = [(i, {k: rng.randrange(3) for k in draw()}, {k: rng.randrange(3) for k in draw()}) for i in range(60)]
    old, new = (spark.createDataFrame([(r[0], r[k]) for r in maps], "_id long, m map<int,int>") for k in (1, 2))
    events = ch.diff_maps(old, new, "m").select(F.lit(1).alias("seq"), "op", "_id", "key", F.col("new").alias("value"))
    got = ch.replay_elements(old.select("_id", F.explode("m").alias("key", "value")), events, ("_id", "key"), "value").collect()
    assert {(r["_id"], r["key"], r["value"]) for r in got} == {(i, k, v) for i, _, m in maps for k, v in m.items()}


def _shuffled(df):
    """The same rows in another order whenever they are asked for."""
    return df.orderBy(F.udf(lambda _: random.random(), "double").asNondeterministic()(F.lit(0)))


def test_ranges_are_merged_alike_however_often_they_are_asked_for(spark):
    rng = random.Random(5)
    rows = [(m := rng.randrange(2_000_000), m + rng.randrange(60)) for _ in range(40_000)]
    want: list[list[int]] = []
    for lo, hi in sorted(rows):
        if want and lo <= want[-1][1]:
            want[-1][1] = max(want[-1][1], hi)
        else:
            want.append([lo, hi])
    df = spark.createDataFrame(rows, "min long, max long")
    assert sorted([*r] for r in kv.coalesced(_shuffled(df), per_cell=200).collect()) == want


def test_cells_stay_as_they_were_cut(spark):
    values = spark.range(2000).select(F.udf(lambda _: random.random(), "double").asNondeterministic()("id").alias("v"))
    cells = Cells.of(values, 2000, 20)
    df = spark.range(500).select((F.col("id") / 500).alias("v"))
    put = lambda: sorted(tuple(r) for r in cells.put(df, F.col("v"), "cell").collect())
    assert put() == put()


def test_conflicts_of_keys_that_share_their_first_bytes(spark):
    """All keys in one cell of their first bytes would let each read meet each write."""
    n = 40_000
    raw = lambda c: F.concat(F.lit(b"a type of object"), F.unhex(F.lpad(F.hex(c), 16, "0")))
    r = spark.range(n).select(F.col("id").alias("tx"), raw(F.col("id") * 4).alias("min"), raw(F.col("id") * 4 + 2).alias("max"))
    w = spark.range(n).select((-F.col("id") - 1).alias("tx"), F.lit("put").alias("kind"), raw(F.col("id") * 4 + 1).alias("key"))
    assert kv.conflicts(r, w).count() == n
    words = spark.createDataFrame([("b",), ("b",), ("cc",), (None,)], "key string")
    ranges = spark.createDataFrame([(1, "a", "c"), (2, "b", "cd"), (2, "b", "cd"), (3, "d", "d"), (4, None, "z"), (5, "bb", "cc")], "tx int, min string, max string")
    assert sorted((x["tx"], x["key"]) for x in kv.within_ranges(words, ranges, 1, 2).collect()) == [(1, "b")] * 2 + [(2, "b")] * 4 + [(2, "cc")] * 2


def test_maps_are_compared_alike_with_few_and_with_many_entries(spark, monkeypatch):
    old = [(1, {"a": 1, "b": None, "c": 3}), (2, {"a": 1}), (3, None), (4, {}), (5, {f"k{i}": i for i in range(100)}), (6, {"gone": 1})]
    new = [(1, {"b": 2, "c": 3, "d": None}), (2, {}), (3, {"x": 1}), (4, None), (5, {f"k{i}": i % 90 for i in range(50, 120)}), (7, {"new": 1})]
    made = lambda rows: spark.createDataFrame(rows, "_id int, m map<string,int>")
    want = set()
    for i, a in old:
        for j, b in new:
            a, b = a or {}, b or {}
            if i == j and a and not b:
                want.add((i, "clear", None, None, None))
            elif i == j:
                want |= {(i, "remove", k, v, None) for k, v in a.items() if k not in b} | {(i, "add", k, None, v) for k, v in b.items() if k not in a}
                want |= {(i, "replace", k, v, b[k]) for k, v in a.items() if k in b and b[k] != v}
    for few in (32, 0, 1000):
        monkeypatch.setattr(ch, "FEW_ENTRIES", few)
        got = [tuple(r) for r in ch.diff_maps(made(old), made(new), "m").select("_id", "op", "key", "old", "new").collect()]
        assert len(got) == len(want) and set(got) == want


def test_elements_are_grouped_once_in_many_partitions(spark):
    old, new = spark.range(0, 40).selectExpr("id % 4 AS _id", "id % 10 AS element"), spark.range(20, 60).selectExpr("id % 4 AS _id", "id % 12 AS element")
    found = ch.diff_elements(old, new, "s")
    a, b = ({(i % 4, i % n) for i in r} for r, n in ((range(40), 10), (range(20, 60), 12)))
    assert sorted(tuple(r) for r in found.collect()) == sorted([("remove s", *x) for x in a - b] + [("add s", *x) for x in b - a])
    assert found.rdd.getNumPartitions() >= 128
