"""Set-like operators on arrays, and boolean queries over them built from Python values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def contains(a: Column, b: Column) -> Column:
    """Whether a holds every element of b."""
    return F.size(F.array_except(b, a)) == 0


def contained_by(a: Column, b: Column) -> Column:
    return contains(b, a)


def matches(array: Column, query) -> Column:
    """A query is a value, or ("and" | "or", query, ...), or ("not", query)."""
    if not isinstance(query, tuple):
        return F.array_contains(array, query)
    head, *rest = query
    if head == "not":
        return ~matches(array, rest[0])
    out = matches(array, rest[0])
    for q in rest[1:]:
        out = out & matches(array, q) if head == "and" else out | matches(array, q)
    return out


def sort_distinct(array: Column) -> Column:
    return F.array_sort(F.array_distinct(array))


def without(array: Column, value) -> Column:
    return F.array_remove(array, value)
