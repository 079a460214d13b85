"""The order of values, in one place.

Null is the greatest value: last in ascending order, first in descending. Beyond that Spark's own order is used, unless a
strict kind asks for a key that orders as an object store's encoding would: by UTF-16 code unit, with -0.0 before 0.0, by
the signed halves of a UUID, by precision of a decimal, by ordinal of an enum.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT = ("utf16", "double", "uuid", "decimal", "unsigned", "bits", "inet", "array")


def sort_key(value: Column, kind: str | None = None, *, names: Sequence[str] = ()) -> Column:
    """A column that Spark orders as the kind asks for; nulls stay null.

    utf16: strings by UTF-16 code unit. double: -0.0 before 0.0, NaN last. uuid: two signed longs. decimal: 1.23 before
    1.230, equal numbers by their number of decimals. unsigned: longs as unsigned. bits: binary as one large unsigned
    number, whatever its leading zeros. inet: IPv4 before IPv6, then by bytes. array: nulls inside last. enum: the place
    in `names`. None: Spark's order.
    """
    if kind is None:
        return value
    if kind == "utf16":
        return F.encode(value, "UTF-16BE")
    if kind == "double":
        # equal under comparison, told apart by their text
        zero = F.when((value == 0) & F.startswith(value.cast("string"), F.lit("-")), 0).otherwise(1)
        return F.when(value.isNotNull(), F.struct(value.alias("value"), zero.alias("sign")))
    if kind == "uuid":
        plain = F.replace(value, F.lit("-"), F.lit(""))
        half = lambda at: F.conv(F.substring(plain, at, 1), 16, 10).cast("int") >= 8  # noqa: E731  the sign bit
        return F.when(value.isNotNull(), F.struct((~half(1)).alias("a"), F.substring(plain, 1, 16).alias("b"), (~half(17)).alias("c"), F.substring(plain, 17, 16).alias("d")))
    if kind == "decimal":
        text = value.cast("string")
        return F.when(value.isNotNull(), F.struct(text.cast("decimal(38,18)").alias("value"), F.length(F.regexp_extract(text, r"\.(\d+)$", 1)).alias("scale")))
    if kind == "unsigned":
        return value.bitwiseXOR(F.lit(-(2**63)))
    if kind == "bits":
        digits = F.regexp_replace(F.hex(value), "^(00)+", "")
        return F.when(value.isNotNull(), F.struct(F.length(digits).alias("length"), digits.alias("digits")))
    if kind == "inet":
        return F.when(value.isNotNull(), F.struct(F.octet_length(value).alias("family"), value.alias("address")))
    if kind == "array":
        return F.transform(value, lambda x: F.struct(x.isNull().alias("none"), x.alias("value")))
    if kind == "enum":
        return F.array_position(F.array(*[F.lit(n) for n in names]), value)
    if kind in _REGISTERED:
        return _REGISTERED[kind](value)
    raise ValueError(f"no such order: {kind}")


_REGISTERED: dict[str, Callable[[Column], Column]] = {}


def register_order(kind: str, key: Callable[[Column], Column]) -> None:
    """Makes an order of one's own known to sort_key: a function from values to a column that Spark orders as they should."""
    if kind in (*STRICT, "enum") or kind in _REGISTERED:
        raise ValueError(f"the order {kind} is there already")
    _REGISTERED[kind] = key


def ascending(*columns: str | Column) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).asc_nulls_last() for c in columns]


def descending(*columns: str | Column) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).desc_nulls_first() for c in columns]
