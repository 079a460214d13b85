"""Predicates on ordered values: bounds, and matchers of stated values and ranges. Null is the greatest value."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class _Open:
    def __repr__(self) -> str:
        return "OPEN"


#: No bound. None is a bound: the value null.
OPEN = _Open()


def _order(value: Any) -> tuple:
    return (1,) if value is None else (0, value)


@dataclass(frozen=True)
class Bounds:
    """A range of values; by default the lower bound is included, the upper is not."""

    lower: Any = OPEN
    upper: Any = OPEN
    lower_in: bool = True
    upper_in: bool = False

    @staticmethod
    def eq(value: Any) -> Bounds:
        return Bounds(value, value, True, True)

    @staticmethod
    def ge(value: Any) -> Bounds:
        return Bounds(lower=value)

    @staticmethod
    def gt(value: Any) -> Bounds:
        return Bounds(lower=value, lower_in=False)

    @staticmethod
    def le(value: Any) -> Bounds:
        return Bounds(upper=value, upper_in=True)

    @staticmethod
    def lt(value: Any) -> Bounds:
        return Bounds(upper=value)

    def with_lower(self, value: Any, included: bool = True) -> Bounds:
        return replace(self, lower=value, lower_in=included)

    def with_upper(self, value: Any, included: bool = False) -> Bounds:
        return replace(self, upper=value, upper_in=included)

    def without_lower(self) -> Bounds:
        return replace(self, lower=OPEN, lower_in=True)

    def without_upper(self) -> Bounds:
        return replace(self, upper=OPEN, upper_in=False)

    def reverse(self) -> Bounds:
        """The same range of the reversed order."""
        return Bounds(self.upper, self.lower, self.upper_in, self.lower_in)

    def above_lower(self, value: Any) -> bool:
        return self.lower is OPEN or _order(value) > _order(self.lower) or (self.lower_in and _order(value) == _order(self.lower))

    def below_upper(self, value: Any) -> bool:
        return self.upper is OPEN or _order(value) < _order(self.upper) or (self.upper_in and _order(value) == _order(self.upper))

    def contains(self, value: Any) -> bool:
        return self.above_lower(value) and self.below_upper(value)

    def is_inverted(self) -> bool:
        return OPEN not in (self.lower, self.upper) and _order(self.lower) > _order(self.upper)

    def is_empty(self) -> bool:
        if self.lower is OPEN or self.upper is OPEN:
            return False
        return self.is_inverted() or (_order(self.lower) == _order(self.upper) and not (self.lower_in and self.upper_in))

    def union(self, other: Bounds) -> Bounds | None:
        """The range that both make together; None if there is a gap between them."""
        a, b = sorted((self, other), key=lambda x: ((0,) if x.lower is OPEN else (1, _order(x.lower), not x.lower_in)))
        if a.upper is not OPEN and b.lower is not OPEN and not (_order(b.lower) < _order(a.upper) or (_order(b.lower) == _order(a.upper) and (a.upper_in or b.lower_in))):
            return None
        if a.upper is OPEN or b.upper is OPEN:
            top = (OPEN, False)
        else:
            top = max(((x.upper, x.upper_in) for x in (a, b)), key=lambda x: (_order(x[0]), x[1]))
        return Bounds(a.lower, top[0], a.lower_in, top[1])

    def predicate(self, value: Column) -> Column:
        """The range as a filter, plain enough to reach the scan; never null."""
        found = F.lit(True)
        if self.lower is not OPEN:
            if self.lower is None:
                found = value.isNull() if self.lower_in else F.lit(False)
            else:
                over = value >= self.lower if self.lower_in else value > self.lower
                found = over if self.upper is not OPEN and self.upper is not None else over | value.isNull()
        if self.upper is not OPEN:
            if self.upper is None:
                found = found if self.upper_in else found & value.isNotNull()
            else:
                found = found & (value <= self.upper if self.upper_in else value < self.upper)
        return F.coalesce(found, F.lit(False)) if OPEN is self.upper and self.lower is not OPEN else found


@dataclass(frozen=True)
class Values:
    """A matcher: nulls, all that is not null, stated values, or ranges [lower, upper)."""

    nulls: bool = False
    non_nulls: bool = False
    literals: Sequence[Any] = ()
    ranges: Sequence[Bounds] = ()

    def contains(self, value: Any) -> bool:
        if value is None:
            return self.nulls
        return self.non_nulls or value in self.literals or any(r.contains(value) for r in self.ranges)

    def predicate(self, value: Column) -> Column:
        found = value.isNull() if self.nulls else F.lit(False)
        if self.non_nulls:
            return found | value.isNotNull()
        if self.literals:
            found = found | (value.isin(*self.literals) & value.isNotNull())
        for r in self.ranges:
            found = found | (r.predicate(value) & value.isNotNull())
        return found


def any_of(*predicates: Column) -> Column:
    """Union of filters."""
    out = F.lit(False)
    for p in predicates:
        out = out | p
    return out


def all_of(*predicates: Column) -> Column:
    """Intersection of filters."""
    out = F.lit(True)
    for p in predicates:
        out = out & p
    return out
