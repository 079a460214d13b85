"""Conversion of values between types, counters, operations on collections and on binary keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole-number types and their bits.
WHOLE = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def narrowed(value: Column, to: str) -> Column:
    """A long as a smaller whole number, keeping the low bits, as casts between machine integers do."""
    bits = WHOLE[to]
    if bits == 64:
        return value.cast("bigint")
    low = value.cast("bigint").bitwiseAND(F.lit((1 << bits) - 1))
    return F.when(low >= 1 << (bits - 1), low - (1 << bits)).otherwise(low).cast(to)


def convert(value: Column, source: str, to: str) -> Column:
    """A value of type `source` as type `to`; null where it has none. Types are Spark's names, and char.

    boolean becomes 1 or 0, and a number is true if it isn't 0. Numbers narrow by their low bits; a fraction is cut off
    and held to the range. char is its code as a number, or a string of one character. Arrays convert by element. Others
    go by way of text.
    """
    if source == to:
        return value
    if source.startswith("array<") and to.startswith("array<"):
        a, b = source[6:-1], to[6:-1]
        return F.transform(value, lambda x: convert(x, a, b))
    if source == "array<char>" and to == "string":
        return F.array_join(value, "")
    if source == "string" and to == "array<char>":
        return F.when(F.length(value) == 0, F.array().cast("array<string>")).otherwise(F.split(value, ""))
    if source == "char":
        return value if to == "string" else convert(F.ascii(value), "int", to)
    if to == "char":
        if source == "string":
            return F.when(F.length(value) == 1, value)
        return F.char(convert(value, source, "bigint").bitwiseAND(F.lit(0xFFFF))) if source != "boolean" else F.char(value.cast("int"))
    if source == "boolean" and to in (*WHOLE, "float", "double"):
        return value.cast("int").cast(to)
    if to == "boolean" and source in (*WHOLE, "float", "double"):
        return value != 0
    if source in WHOLE and to in WHOLE:
        return narrowed(value, to) if WHOLE[to] < WHOLE[source] else value.cast(to)
    if source in ("float", "double") and to in WHOLE:
        bits = max(32, WHOLE[to])
        top = F.lit(2 ** (bits - 1) - 1)
        held = F.when(F.isnan(value), F.lit(0)).when(value >= 2.0 ** (bits - 1), top).when(value <= -(2.0 ** (bits - 1)), -top - 1).otherwise(value.try_cast("bigint"))
        return F.when(value.isNotNull(), narrowed(held, to))
    if to == "string":
        return value.cast("string")
    return value.cast("string").try_cast(to)


def upgraded(value: Column, source: str, to: str, policy: str, default: object = None) -> Column:
    """A field's value after its type changed. RESET: the default. ATTEMPT: converted, or else the default. REQUIRE:
    converted; a value that can't be ends the query."""
    if policy == "RESET":
        return F.lit(default).cast(to if to != "char" else "string")
    found = convert(value, source, to)
    if policy == "ATTEMPT":
        return F.coalesce(found, F.lit(default)) if default is not None else found
    if policy == "REQUIRE":
        return F.when(value.isNotNull() & found.isNull(), F.raise_error(F.concat(F.lit(f"can't convert to {to}: "), value.cast("string"))).cast(to if to != "char" else "string")).otherwise(found)
    raise ValueError(f"no such policy: {policy}")


def adjusted(counter: Column, *deltas: Column) -> Column:
    """A counter after adjustments, which commute."""
    out = F.coalesce(counter, F.lit(0)).cast("bigint")
    for d in deltas:
        out = out + F.coalesce(d, F.lit(0))
    return out


def list_set(value: Column, index: int, element: Column) -> Column:
    """The list with the element at a place, from 0, replaced."""
    return F.transform(value, lambda x, i: F.when(i == index, element).otherwise(x))


def list_insert(value: Column, index: int, element: Column) -> Column:
    return F.concat(F.slice(value, 1, index) if index else F.slice(value, 1, 0), F.array(element), F.slice(value, F.lit(index + 1), F.greatest(F.size(value) - index, F.lit(0))))


def list_remove(value: Column, index: int) -> Column:
    """The list without the element at a place; later ones move up."""
    return F.filter(value, lambda x, i: i != index)


def set_of(value: Column) -> Column:
    """A list as a set field holds it: distinct, in order, null last."""
    return F.array_sort(F.array_distinct(value))


def set_add(value: Column, element: Column) -> Column:
    return set_of(F.array_append(value, element))


def set_remove(value: Column, element: Column) -> Column:
    return F.filter(value, lambda x: ~x.eqNullSafe(element))


def map_put(value: Column, key: Column, entry: Column) -> Column:
    """The map with an entry put in, in place of one with the same key."""
    return F.map_concat(F.map_filter(value, lambda k, _: k != key), F.create_map(key, entry))


def map_remove(value: Column, key: Column) -> Column:
    return F.map_filter(value, lambda k, _: k != key)


def next_key(key: Column) -> Column:
    """The smallest binary key above a key."""
    return F.concat(key, F.lit(b"\x00"))


def key_after_prefix(prefix: bytes) -> bytes | None:
    """The smallest key above all keys with a prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def ordered_bytes(value: Column) -> Column:
    """Longs as 8 bytes that order as the numbers do."""
    return F.unhex(F.lpad(F.hex(value.bitwiseXOR(F.lit(-(2**63)))), 16, "0"))


def from_ordered_bytes(value: Column) -> Column:
    digits = F.hex(value)
    high, low = F.conv(F.substring(digits, 1, 8), 16, 10).cast("bigint"), F.conv(F.substring(digits, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low).bitwiseXOR(F.lit(-(2**63)))
