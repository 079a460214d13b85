"""Extents, indexes, sets, navigation, paths, cascades and deletion over small models."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, navigate, paths, sets
from tessera.operators.bounds import Bounds
from tessera.operators.index import composite_index, in_versions, list_index, map_value_index, simple_index
from tessera.operators.model import Field, Model, ObjType, Snapshot, ref

IDX, EL = frozenset({""}), frozenset({"element"})


@pytest.fixture(scope="module")
def people(spark):
    model = Model(
        [
            ObjType("Person", (Field("name", indexed=IDX), ref("friend", "Person", "Robot"), Field("nicknames", "set", indexed=EL), Field("scores", "list", indexed=EL), Field("ratings", "map", indexed=frozenset({"key", "value"})), Field("age", indexed=IDX, default=0)), interfaces=("Named",), composites={"nameAge": ("name", "age")}),
            ObjType("Robot", (Field("name", indexed=IDX), Field("secret")), interfaces=("Named",)),
        ]
    )
    person = spark.createDataFrame(
        [(1, "alice", 2, ["a", "al"], [5, 5, 7], {"x": 1, "y": 1}, 12), (2, "bob", 9, ["b"], [7], {"x": 2}, 42), (3, "bob", None, [], [], {}, 8), (4, None, 1, ["a"], [5], {"y": 1}, None), (5, "eve", 77, None, None, None, 73)],
        "_id long, name string, friend long, nicknames array<string>, scores array<int>, ratings map<string,int>, age int",
    )
    robot = spark.createDataFrame([(9, "bob", "s"), (10, "c3", "t")], "_id long, name string, secret string")
    return Snapshot(model, {"Person": person, "Robot": robot})


def rows(df, *names):
    return [tuple(r) for r in (df.select(*names) if names else df).collect()]


def check_set(view, want):
    """In order, and in reverse order."""
    assert rows(view.as_set()) == want
    assert rows(view.as_set(True)) == want[::-1]


def test_extents(people):
    assert sorted(rows(people.extent("Named"))) == [("Person", i) for i in range(1, 6)] + [("Robot", 9), ("Robot", 10)]
    assert people.extent().count() == 7 and rows(people.singleton("Robot"), "_id") == [(9,)]
    with pytest.raises(KeyError):
        people.extent("None such")
    assert sorted(rows(people.read("Person", "age"), "age")) == [(0,), (8,), (12,), (42,), (73,)]


def test_simple_index_over_types(people):
    check_set(simple_index(people, "Named", "name"), [("alice", 1), ("bob", 2), ("bob", 3), ("bob", 9), ("c3", 10), ("eve", 5), (None, 4)])
    assert rows(simple_index(people, "Person", "name").get("bob").orderBy("_id")) == [(2,), (3,)]
    assert rows(simple_index(people, "Person", "name").get(None)) == [(4,)]
    assert dict(rows(simple_index(people, "Named", "name").as_map()))["bob"] == [2, 3, 9]
    check_set(simple_index(people, "Named", "name").within(Bounds.ge("c")), [("c3", 10), ("eve", 5), (None, 4)])
    check_set(simple_index(people, "Named", "name").within_target(Bounds(2, 5)), [("bob", 2), ("bob", 3), (None, 4)])


def test_collection_indexes(people):
    check_set(simple_index(people, "Person", "nicknames.element"), [("a", 1), ("a", 4), ("al", 1), ("b", 2)])
    check_set(simple_index(people, "Person", "scores.element"), [(5, 1), (5, 4), (7, 1), (7, 2)])
    check_set(list_index(people, "Person", "scores"), [(5, 1, 0), (5, 1, 1), (5, 4, 0), (7, 1, 2), (7, 2, 0)])
    check_set(simple_index(people, "Person", "ratings.key"), [("x", 1), ("x", 2), ("y", 1), ("y", 4)])
    check_set(map_value_index(people, "Person", "ratings"), [(1, 1, "x"), (1, 1, "y"), (1, 4, "y"), (2, 2, "x")])


def test_composite_index(people):
    v = composite_index(people, "Person", "nameAge")
    check_set(v, [("alice", 12, 1), ("bob", 8, 3), ("bob", 42, 2), ("eve", 73, 5), (None, None, 4)])
    check_set(v.as_index(1), [("alice", 12), ("bob", 8), ("bob", 42), ("eve", 73), (None, None)])
    check_set(v.within(Bounds("b", "c")).within(Bounds.gt(8), 2), [("bob", 42, 2)])
    assert dict(rows(v.as_map_of_index(1)))["bob"] == 2 and v.nested(1).where("name = 'bob'").first().entries[0].age == 8
    versions = people.of("Person").select("_id", F.when(F.col("_id") < 3, 1).otherwise(2).alias("_version"))
    assert in_versions(v, versions, 1).as_set().count() == 2


def test_prefixes_fall_together(spark):
    model = Model([ObjType("Foo", (Field("i", indexed=IDX), ref("r", "Foo")), composites={"ir": ("i", "r")})])
    s = Snapshot(model, {"Foo": spark.createDataFrame([(1, 555, 3), (2, 555, 4), (3, 666, 3), (4, 666, 4), (5, 666, 4)], "_id long, i int, r long")})
    v = composite_index(s, "Foo", "ir")
    assert v.as_set().count() == 5
    check_set(v.as_index(1), [(555, 3), (555, 4), (666, 3), (666, 4)])


def test_refused_queries(people):
    for bad in (lambda: simple_index(people, "Robot", "secret"), lambda: simple_index(people, "Person", "nicknames"), lambda: composite_index(people, "Person", "nameAge").as_index(2), lambda: composite_index(people, "Person", "nameAge").within(Bounds(), 3)):
        with pytest.raises(ValueError):
            bad()
    for bad in (lambda: simple_index(people, "Person", "none"), lambda: composite_index(people, "Robot", "nameAge")):
        with pytest.raises(KeyError):
            bad()
    for bad in (lambda: ObjType("A", (Field("a"),), composites={"x": ("a",)}), lambda: Field("a", "other"), lambda: ref("a", "A", on_delete="REMOVE"), lambda: Field("a", unique=True), lambda: ObjType("A", (Field("a", "set"), Field("b")), composites={"x": ("a", "b")})):
        with pytest.raises(ValueError):
            bad()


def test_set_families_equal_a_model(spark):
    rng = random.Random(11)
    for _ in range(8):
        family = [{rng.randrange(100) for _ in range(rng.randrange(65))} for _ in range(rng.randrange(1, 5))]
        frames = [spark.createDataFrame([(x,) for x in f for _ in range(2)], "v int") for f in family]
        got = lambda df: [r.v for r in sets.ordered(df).collect()]
        assert got(sets.union(*frames)) == sorted(set.union(*family))
        assert got(sets.intersection(*frames)) == sorted(set.intersection(*family))
        assert got(sets.difference(frames[0], frames[-1])) == sorted(family[0] - family[-1])
        assert got(sets.symmetric_difference(frames[0], frames[-1])) == sorted(family[0] ^ family[-1])
    with pytest.raises(ValueError):
        sets.union(spark.createDataFrame([(1,)], "v int"), spark.createDataFrame([("a",)], "v string"))


def test_navigation(spark):
    df = spark.createDataFrame([(x,) for x in (1, 3, 5, None)], "v int")
    at = lambda d: [r.v for r in d.collect()]
    assert (at(navigate.first(df, "v")), at(navigate.last(df, "v"))) == ([1], [None])
    assert [at(f(df, "v", 3)) for f in (navigate.lower, navigate.floor, navigate.ceiling, navigate.higher)] == [[1], [3], [3], [5]]
    assert [at(f(df, "v", 9)) for f in (navigate.floor, navigate.ceiling)] == [[5], [None]] and at(navigate.lower(df, "v", 1)) == []
    with pytest.raises(LookupError):
        navigate.required(navigate.lower(df, "v", 1))
    top, rest = navigate.poll_last(df, "v")
    assert at(top) == [None] and sorted(at(rest)) == [1, 3, 5]
    assert at(navigate.sub_set(df, "v", Bounds(1, 5), True)) == [3, 1]


def test_floors_equal_a_model(spark):
    rng = random.Random(5)
    left = [(i, rng.choice("ab"), rng.choice([None, *range(50)])) for i in range(80)]
    right = [(rng.choice("ab"), rng.randrange(50)) for _ in range(15)]
    a, b = spark.createDataFrame(left, "i int, g string, t int"), spark.createDataFrame(right, "g string, t int")
    for inclusive in (True, False):
        for by in ((), ("g",)):
            got = {r.i: r.floor_t for r in navigate.floors(a, b, "t", by, carry=["t"], inclusive=inclusive, cells=7).collect()}
            for i, g, t in left:
                near = [u for h, u in right if t is not None and (not by or h == g) and (u <= t if inclusive else u < t)]
                assert got[i] == max(near, default=None), (i, g, t)


def test_pages(spark):
    p = navigate.Pager(spark.range(95).toDF("k"), "k", 10)
    keys = lambda x: [r.k for r in x.page().collect()]
    assert keys(p) == [*range(10)] and keys(p.next()) == [*range(10, 20)] and keys(p.next().next().previous()) == [*range(10, 20)] and keys(p.next().previous()) == [*range(10)]
    assert keys(p.last()) == [*range(85, 95)] and keys(p.at(50)) == [*range(51, 61)] and keys(p.filtered(F.col("k") % 2 == 0).next()) == [*range(20, 40, 2)]
    d = navigate.Pager(spark.range(25).toDF("k"), "k", 10, True)
    assert keys(d.next()) == [*range(14, 4, -1)] and keys(d.last()) == [*range(9, -1, -1)]


def test_paths(people):
    ids = lambda df: sorted(rows(df))
    follow = lambda start, text, w: ids(paths.follow(people, paths.parse(people.model, start, text), people.extent(start).where(w)))
    assert follow("Person", "->friend", "_id IN (1, 2)") == [("Person", 2), ("Robot", 9)]
    assert follow("Person", "->friend->friend", "_id IN (1, 4)") == [("Person", 2), ("Robot", 9)]
    assert follow("Named", "<-Person.friend", "_id IN (9, 1)") == [("Person", 2), ("Person", 4)]
    assert follow("Named", "", "_id > 4") == [("Person", 5), ("Robot", 9), ("Robot", 10)]
    back = paths.follow_back(people, paths.parse(people.model, "Person", "->friend->friend"), people.extent("Robot"))
    assert ids(back) == [("Person", 1)]
    p = paths.parse(people.model, "Person", "->friend<-Person.friend")
    assert not p.is_singular() and p.targets == ("Person",) and p.fields == ["friend", "friend"] and paths.parse(people.model, "Person", "->friend").is_singular()


@pytest.mark.parametrize("text", ["friend", "->", "->none", "<-friend", "->name", "<-Robot.name", "->friend.x", "->friend ->friend", "->Robot.friend"])
def test_bad_paths(people, text):
    with pytest.raises((ValueError, KeyError)):
        paths.parse(people.model, "Person", text)


def tree(spark, **more):
    model = Model([ObjType("Node", (ref("parent", "Node", cascades=frozenset({"tree"}), inverse_cascades=frozenset({"tree", "down"}), **more),)), ObjType("Other", (ref("node", "Node", on_delete="DELETE"),))])
    return Snapshot(model, {"Node": spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, 5), (6, 7), (7, 6)], "_id long, parent long"), "Other": spark.createDataFrame([(20, 4), (21, 3), (22, None)], "_id long, node long")})


def start_of(spark, *ids):
    return spark.createDataFrame([("Node", i) for i in ids], "_type string, _id long")


def test_cascades(spark):
    s = tree(spark)
    def run(name, start, most=-1, visited=None):
        e = graph.cascade_edges(s, name)
        v = None if visited is None else graph.nodes(start_of(spark, *visited))
        return sorted((r.node["_id"], r.distance) for r in graph.cascade(e, graph.nodes(start_of(spark, *start)), most, v).collect())
    assert run("down", [1]) == [(1, 0), (2, 1), (3, 1), (4, 2)] and run("down", [1], 0) == [(1, 0)] and run("down", [1], 1) == [(1, 0), (2, 1), (3, 1)]
    assert run("tree", [4]) == [(1, 2), (2, 1), (3, 3), (4, 0)] and run("down", [6]) == [(6, 0), (7, 1)] and run("down", [5]) == [(5, 0)]
    assert run("down", [1], -1, [2]) == [(1, 0), (3, 1)] and run("down", [1], -1, [1]) == []


@pytest.mark.parametrize("action", ["IGNORE", "EXCEPTION", "NULLIFY", "DELETE"])
def test_delete_actions_on_references(spark, action):
    d = graph.delete(tree(spark, on_delete=action), start_of(spark, 2))
    after = dict(rows(d.after.of("Node"), "_id", "parent"))
    if action == "EXCEPTION":
        with pytest.raises(ValueError):
            d.checked()
        return
    assert 2 not in after and d.blockers.isEmpty()
    assert after.get(4, "gone") == {"IGNORE": 2, "NULLIFY": None, "DELETE": "gone"}[action]
    assert sorted(i for i, _ in rows(d.after.of("Other"))) == ([21, 22] if action == "DELETE" else [20, 21, 22])


def test_self_references_and_forward_delete(spark):
    assert graph.delete(tree(spark), start_of(spark, 5)).checked().of("Node").count() == 6
    d = graph.delete(tree(spark, on_delete="IGNORE", forward_delete=True), start_of(spark, 4))
    assert sorted(i for i, _ in rows(d.after.of("Node"))) == [3, 5, 6, 7]


@pytest.mark.parametrize(("kind", "action", "want"), [("list", "REMOVE", [3, 4, 3]), ("list", "NULLIFY", [None, 3, None, 4, 3]), ("set", "NULLIFY", [None, 3, 4]), ("set", "REMOVE", [3, 4, 3]), ("list", "IGNORE", [1, 3, 1, 4, 3])])
def test_delete_actions_on_collections(spark, kind, action, want):
    model = Model([ObjType("Node", ()), ObjType("Holder", (Field("held", kind, refs={"element": ("Node",)}, on_delete=action),))])
    s = Snapshot(model, {"Node": spark.createDataFrame([(1,), (3,), (4,)], "_id long"), "Holder": spark.createDataFrame([(9, [1, 3, 1, 4, 3])], "_id long, held array<long>")})
    assert graph.delete(s, start_of(spark, 1)).checked().of("Holder").first().held == want


def test_delete_actions_on_maps(spark):
    for part, action, want in (("key", "REMOVE", {3: 1}), ("value", "REMOVE", {1: 3}), ("value", "NULLIFY", {1: 3, 3: None})):
        model = Model([ObjType("Node", ()), ObjType("Holder", (Field("held", "map", refs={part: ("Node",)}, on_delete=action),))])
        s = Snapshot(model, {"Node": spark.createDataFrame([(1,), (3,)], "_id long"), "Holder": spark.createDataFrame([(9, {1: 3, 3: 1})], "_id long, held map<long,long>")})
        assert graph.delete(s, start_of(spark, 1)).checked().of("Holder").first().held == want


def test_copies_and_new_ids(spark):
    s = tree(spark)
    into = Snapshot(s.model, {"Node": s.of("Node").limit(0), "Other": s.of("Other").limit(0)})
    assert sorted(i for i, _ in rows(graph.copy_closure(s, into, start_of(spark, 2), ["down"]).of("Node"))) == [2, 4]
    ids = s.of("Node").select(F.col("_id").alias("old"), (F.col("_id") + 100).alias("new"))
    assert (104, 102) in rows(graph.with_new_ids(s.of("Node"), ["parent"], ids), "_id", "parent")
    assert rows(graph.dangling(s.replaced(Node=s.of("Node").where("_id <> 4"))), "_type", "_id", "to_id") == [("Other", 20, 4)]
    assert sorted(rows(graph.unreferenced(s, "Node"))) == []
