"""Ordered lists, sets, vectors and maps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_items(items: Column) -> Column:
    """Items in the order of their first appearance (SET1)."""
    return F.array_distinct(items)


def union_items(a: Column, b: Column) -> Column:
    """Items of a, then the new ones of b (SET2)."""
    return F.array_union(a, b)


def common_items(a: Column, b: Column) -> Column:
    """Items of a that b has too, in the order of a, once each (SET3)."""
    return F.array_intersect(a, b)


def flat_set(lists: Column) -> Column:
    """All items of a list of lists, once each (SET5)."""
    return F.array_distinct(F.flatten(lists))


def powerset(items: Column, kind: str = "string", longest: int | None = None) -> Column:
    """All sublists, those of at most ``longest`` items if it is given (SET6).
    2 ** n of them for n items, so callers keep lists short or give a length."""
    longer = lambda sets, x: F.transform(sets if longest is None else F.filter(sets, lambda s: F.size(s) < longest), lambda s: F.array_append(s, x))
    return F.aggregate(items, F.array(F.array().cast(f"array<{kind}>")), lambda sets, x: F.concat(sets, longer(sets, x)))


def combinations(items: Column, n: int, kind: str = "string") -> Column:
    """Sublists of exactly n items, in order (SET6)."""
    return F.filter(powerset(items, kind, n), lambda s: F.size(s) == n)


def product(a: Column, b: Column) -> Column:
    """All pairs (x, y) of two short lists (SET6)."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def clamp(value: Column, low, high) -> Column:
    """The value held between two bounds (NUM1)."""
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def sum_lists(a: Column, b: Column) -> Column:
    """Sums by element; the longer list's rest stays as it is (NUM2)."""
    zero = F.lit(0.0)
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def sparse(v: Column) -> Column:
    """Index to value of the entries other than zero (ARR1)."""
    return F.map_filter(F.map_from_arrays(F.sequence(F.lit(0), F.size(v) - 1), v), lambda _, x: x != 0)


def relative(v: Column) -> Column:
    """Entries divided by their sum; as they are if it is zero (ARR1)."""
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return F.transform(v, lambda x: F.when(total == 0, x).otherwise(x / total))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def with_defaults(own: Column, defaults: Column) -> Column:
    """Properties, with defaults for the keys that are absent or null (MAP1)."""
    return F.map_zip_with(defaults, own, lambda _, d, x: F.coalesce(x, d))


def listed(items: Column, sep: str = ", ", last: str = " and ") -> Column:
    """a, b and c (STR24)."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), sep)
    return F.when(n < 2, F.array_join(items, sep)).otherwise(F.concat(head, F.lit(last), F.element_at(items, -1)))


def slice_text(text: Column, first, last) -> Column:
    """Characters first to last - 1, white space as single spaces (STR29)."""
    return F.trim(F.regexp_replace(F.substring(text, F.lit(first) + 1, F.lit(last) - F.lit(first)), r"[ \t\n\f\r]+", " "))
