"""Boolean building blocks with defined results for nothing and for NULL."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_ as _and
from operator import or_ as _or

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(*predicates: Column | None) -> Column:
    """Conjunction; None is left out, nothing left is TRUE."""
    own = [p for p in predicates if p is not None]
    return reduce(_and, own) if own else F.lit(True)


def any_of(*predicates: Column | None) -> Column:
    """Disjunction; None is left out, nothing left is FALSE."""
    own = [p for p in predicates if p is not None]
    return reduce(_or, own) if own else F.lit(False)


def negated(predicate: Column | None) -> Column:
    return ~(F.lit(True) if predicate is None else predicate)


def in_list(value: Column, items: Iterable) -> Column:
    """IN; an empty list is FALSE, also for NULL."""
    own = list(items)
    return value.isin(own) if own else F.lit(False)


def not_in_list(value: Column, items: Iterable) -> Column:
    """NOT IN; an empty list is TRUE, also for NULL."""
    own = list(items)
    return ~value.isin(own) if own else F.lit(True)


def distinct_from(a: Column, b: Column) -> Column:
    """NULL-safe inequality."""
    return ~a.eqNullSafe(b)


def between(value: Column, low, high, symmetric: bool = False) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return value.between(F.least(low, high), F.greatest(low, high)) if symmetric else value.between(low, high)


def in_projection(value: Column, found: Column, any_null: Column, empty: Column) -> Column:
    """IN as a value: TRUE, FALSE or NULL, from whether a match, a NULL or nothing is on the right."""
    return F.when(empty, False).when(found, True).when(value.isNull() | any_null, F.lit(None).cast("boolean")).otherwise(False)
