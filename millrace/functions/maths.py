"""Arithmetic where a dialect's rule is not Spark's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column, integral: bool) -> Column:
    """Integers divide towards zero, others as doubles; zero is an error."""
    return F.call_function("div", a, b) if integral else a / b


def log(value: Column) -> Column:
    """Base 10."""
    return F.log10(value)


def truncate(value: Column, digits: int = 0) -> Column:
    """Towards zero."""
    scale = F.lit(10.0**digits)
    return F.signum(value) * F.floor(F.abs(value) * scale) / scale


def round_half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def greatest(*values: Column, nulls: str = "ignore") -> Column:
    """``nulls``: ignore them, or let any make the result NULL (propagate)."""
    return F.greatest(*values) if nulls == "ignore" else F.when(~_any_null(values), F.greatest(*values))


def least(*values: Column, nulls: str = "ignore") -> Column:
    return F.least(*values) if nulls == "ignore" else F.when(~_any_null(values), F.least(*values))


def _any_null(values: tuple[Column, ...]) -> Column:
    out = values[0].isNull()
    for v in values[1:]:
        out = out | v.isNull()
    return out


def forgiving_div(a: Column, b: Column) -> Column:
    """NULL for a zero divisor."""
    return F.try_divide(a, b)
