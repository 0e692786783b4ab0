"""Array functions with PostgreSQL's rules for NULL and nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains(a: Column, b: Column) -> Column:
    """Every element of b is in a; a NULL element is in nothing."""
    return F.forall(b, lambda x: F.coalesce(F.array_contains(a, x), F.lit(False)))


def contained_in(a: Column, b: Column) -> Column:
    return contains(b, a)


def overlaps(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def equals_any(value: Column, array: Column) -> Column:
    return F.exists(array, lambda x: x == value)


def equals_all(value: Column, array: Column) -> Column:
    return F.forall(array, lambda x: x == value)


def length(array: Column) -> Column:
    """NULL for an empty array."""
    return F.nullif(F.cardinality(array), F.lit(0))


def replace(array: Column, old: Column, new: Column) -> Column:
    return F.transform(array, lambda x: F.when(x.eqNullSafe(old), new).otherwise(x))


def position(array: Column, value: Column) -> Column:
    """1-based; NULL where absent."""
    return F.nullif(F.array_position(array, value), F.lit(0).cast("long"))


def positions(array: Column, value: Column) -> Column:
    places = F.transform(array, lambda x, i: F.when(x.eqNullSafe(value), i + 1))
    return F.filter(places, lambda p: p.isNotNull())


def to_string(array: Column, separator: str, null: str | None = None) -> Column:
    return F.array_join(array, separator) if null is None else F.array_join(array, separator, null)


def from_string(text: Column, separator: str) -> Column:
    return F.split(text, "\\Q" + separator + "\\E")
