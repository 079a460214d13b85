"""Orders, conversions, bounds and key ranges, against plain Python models."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.functions import convert as cv
from tessera.functions.ordering import ascending, descending, sort_key
from tessera.operators.bounds import OPEN, Bounds, Values, all_of, any_of
from tessera.operators.kv import KeyRange, KeyRanges

NULLS_LAST = lambda v: (v is None, v if v is not None else 0)


def test_null_is_the_greatest_value(spark):
    df = spark.createDataFrame([(x,) for x in (3, None, 1, 2)], "v int")
    assert [r.v for r in df.orderBy(*ascending("v")).collect()] == [1, 2, 3, None]
    assert [r.v for r in df.orderBy(*descending("v")).collect()] == [None, 3, 2, 1]


@pytest.mark.parametrize(
    ("kind", "type_", "values"),
    [
        ("utf16", "string", ["", "a", "b", "😀", "￮"]),
        ("double", "double", [float("-inf"), -1.0, -0.0, 0.0, 1.0, float("inf"), float("nan")]),
        ("decimal", "string", ["-1", "1.2", "1.23", "1.230", "1.3", "10"]),
        ("uuid", "string", ["80000000-0000-0000-0000-000000000000", "ffffffff-0000-0000-8000-000000000000", "ffffffff-0000-0000-0000-000000000001", "00000000-0000-0000-0000-000000000000", "7fffffff-0000-0000-0000-000000000000"]),
        ("unsigned", "bigint", [0, 1, 2**62, -1 - 2**62, -1]),
        ("bits", "binary", [b"", b"\x01", b"\x00\x02", b"\xff", b"\x01\x00"]),
        ("inet", "binary", [b"\x01\x02\x03\x04", b"\xff\x00\x00\x00", b"\x00" * 16]),
        ("array", "array<int>", [[], [1], [1, 2], [1, None], [2], [None]]),
    ],
)
def test_strict_orders(spark, kind, type_, values):
    rows = list(enumerate(values))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, f"i int, v {type_}")
    assert [r.i for r in df.orderBy(sort_key(F.col("v"), kind).asc_nulls_last()).collect()] == list(range(len(values)))


def test_enum_order(spark):
    df = spark.createDataFrame([("HAPPY",), ("MAD",), ("NORMAL",)], "v string")
    assert [r.v for r in df.orderBy(sort_key(F.col("v"), "enum", names=("MAD", "NORMAL", "HAPPY"))).collect()] == ["MAD", "NORMAL", "HAPPY"]
    with pytest.raises(ValueError):
        sort_key(F.col("v"), "none such")


CASES = [
    (300, "int", "tinyint", 44),
    (200, "int", "tinyint", -56),
    (2**40 + 5, "bigint", "int", 5),
    (-1, "bigint", "smallint", -1),
    (1e20, "double", "int", 2**31 - 1),
    (-1.9, "double", "int", -1),
    (float("nan"), "double", "bigint", 0),
    (True, "boolean", "int", 1),
    (0.0, "double", "boolean", False),
    (7, "int", "boolean", True),
    ("12", "string", "int", 12),
    ("x", "string", "int", None),
    ("true", "string", "boolean", True),
    (65, "int", "char", "A"),
    ("A", "char", "int", 65),
    ("AB", "string", "char", None),
    ("A", "string", "char", "A"),
    ([1, 300], "array<int>", "array<tinyint>", [1, 44]),
    (["a", "b"], "array<char>", "string", "ab"),
    ("ab", "string", "array<char>", ["a", "b"]),
    (None, "int", "string", None),
]


@pytest.mark.parametrize(("value", "source", "to", "want"), CASES)
def test_conversions(spark, value, source, to, want):
    stored = source.replace("char", "string")
    df = spark.createDataFrame([(value,)], f"v {stored}")
    assert df.select(cv.convert(F.col("v"), source, to).alias("v")).first().v == want


def test_upgrade_policies(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "v string")
    got = lambda p, d=None: [r.v for r in df.select(cv.upgraded(F.col("v"), "string", "int", p, d).alias("v")).collect()]
    assert got("RESET", 9) == [9, 9, 9] and got("ATTEMPT", 9) == [1, 9, 9] and got("ATTEMPT") == [1, None, None]
    with pytest.raises(Exception, match="can't convert"):
        got("REQUIRE")
    with pytest.raises(ValueError):
        got("SOMETIMES")


def test_collections_and_keys(spark):
    df = spark.createDataFrame([([3, 1, 3, 2], {"a": 1, "b": 2}, -5)], "l array<int>, m map<string,int>, k bigint")
    r = df.select(
        cv.list_set(F.col("l"), 1, F.lit(9)).alias("set"), cv.list_insert(F.col("l"), 0, F.lit(7)).alias("front"), cv.list_insert(F.col("l"), 4, F.lit(7)).alias("back"), cv.list_remove(F.col("l"), 0).alias("cut"),
        cv.set_of(F.col("l")).alias("s"), cv.set_add(F.col("l"), F.lit(0)).alias("more"), cv.set_remove(F.col("l"), F.lit(3)).alias("less"),
        cv.map_put(F.col("m"), F.lit("a"), F.lit(5)).alias("put"), cv.map_remove(F.col("m"), F.lit("a")).alias("gone"), cv.adjusted(F.lit(None), F.lit(2), F.lit(-1)).alias("count"),
        cv.from_ordered_bytes(cv.ordered_bytes(F.col("k"))).alias("k"), cv.next_key(F.lit(b"a")).alias("next"),
    ).first()
    assert (r["set"], r.front, r.back, r.cut) == ([3, 9, 3, 2], [7, 3, 1, 3, 2], [3, 1, 3, 2, 7], [1, 3, 2])
    assert (r.s, r.more, r.less) == ([1, 2, 3], [0, 1, 2, 3], [1, 2])
    assert (r.put, r.gone, r["count"], r.k, bytes(r.next)) == ({"b": 2, "a": 5}, {"b": 2}, 1, -5, b"a\x00")
    assert cv.key_after_prefix(b"a\xff") == b"b" and cv.key_after_prefix(b"\xff") is None
    keys = spark.createDataFrame([(x,) for x in (5, -1, -(2**63), 2**63 - 1, 0)], "k bigint")
    assert [r.k for r in keys.orderBy(cv.ordered_bytes(F.col("k"))).collect()] == [-(2**63), -1, 0, 5, 2**63 - 1]


def random_bounds(rng):
    pick = lambda: rng.choice([OPEN, OPEN, None, *range(6)])
    return Bounds(pick(), pick(), rng.random() < 0.5, rng.random() < 0.5)


def test_bounds_equal_a_model(spark):
    rng, values = random.Random(7), [None, *range(6)]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    made = [random_bounds(rng) for _ in range(60)]
    got = df.select("v", *[b.predicate(F.col("v")).alias(f"b{i}") for i, b in enumerate(made)]).collect()
    for r in got:
        for i, b in enumerate(made):
            assert bool(r[f"b{i}"]) == b.contains(r.v), (b, r.v)
    for b in made:
        if b.is_empty():
            assert not any(b.contains(v) for v in values)
        for other in made:
            both = b.union(other)
            if both is not None and not b.is_empty() and not other.is_empty():
                assert all(both.contains(v) == (b.contains(v) or other.contains(v)) or both.contains(v) for v in values)
                assert all(both.contains(v) for v in values if b.contains(v) or other.contains(v))


def test_bounds_parts():
    assert Bounds(0, 10).union(Bounds(10, 20)) == Bounds(0, 20) and Bounds(0, 10).union(Bounds(11, 20)) is None
    assert Bounds.gt(5).union(Bounds.le(5)) == Bounds() and Bounds(3, 1).is_inverted() and Bounds(1, 1).is_empty() and not Bounds.eq(1).is_empty()
    assert Bounds(1, 5).reverse() == Bounds(5, 1, False, True)
    assert Bounds(1, 5).without_lower() == Bounds.lt(5) and Bounds.ge(1).with_upper(5) == Bounds(1, 5) and Bounds.lt(5).with_lower(1) == Bounds(1, 5) and Bounds(1, 5).without_upper() == Bounds.ge(1)


def test_values(spark):
    df = spark.createDataFrame([(v,) for v in (None, 1, 5, 15, 25)], "v int")
    for m in (Values(nulls=True), Values(non_nulls=True), Values(literals=(1, 5)), Values(nulls=True, ranges=(Bounds(5, 25),)), Values()):
        assert [bool(r.p) for r in df.select(m.predicate(F.col("v")).alias("p")).collect()] == [m.contains(v) for v in (None, 1, 5, 15, 25)]
    assert df.where(any_of(F.col("v") == 1, F.col("v") == 5)).count() == 2 and df.where(all_of(F.col("v") > 1, F.col("v") < 20)).count() == 2


def test_key_ranges_equal_a_model():
    rng = random.Random(3)
    made = lambda: KeyRanges([KeyRange(*sorted((rng.choice([None, *range(20)]), rng.choice(range(20))), key=lambda x: -1 if x is None else x)) for _ in range(rng.randrange(5))] + [KeyRange(rng.randrange(20), None)] * (rng.random() < 0.2))
    for _ in range(300):
        a, b = made(), made()
        for k in range(-1, 21):
            assert a.union(b).contains(k) == (a.contains(k) or b.contains(k))
            assert a.intersection(b).contains(k) == (a.contains(k) and b.contains(k))
            assert a.inverse().contains(k) != a.contains(k)
            assert a.difference(b).contains(k) == (a.contains(k) and not b.contains(k))
        assert a.inverse().inverse() == a
    assert KeyRange(1, 5).overlaps(KeyRange(4, 9)) and not KeyRange(1, 5).overlaps(KeyRange(5, 9)) and KeyRange.prefix(b"a").contains(b"ab") and KeyRange.prefix(b"a").is_prefix(b"a")


def test_decimal_keys_keep_numbers_together(spark):
    df = spark.createDataFrame([(Decimal("1.50"),), (Decimal("1.25"),)], "v decimal(10,2)")
    assert [r.v for r in df.orderBy(sort_key(F.col("v"), "decimal")).collect()] == [Decimal("1.25"), Decimal("1.50")]
