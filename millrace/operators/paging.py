"""Keyset pagination that is right across NULLs, and opaque cursors."""

from __future__ import annotations

import base64
import datetime
import decimal
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from millrace.operators.predicates import all_of, any_of


@dataclass(frozen=True)
class Key:
    """A sort key; ``nulls_last`` None means last when ascending and first when descending."""

    column: str
    descending: bool = False
    nulls_last: bool | None = None

    @property
    def last(self) -> bool:
        return not self.descending if self.nulls_last is None else self.nulls_last

    def order(self) -> Column:
        c = F.col(self.column)
        if self.descending:
            return c.desc_nulls_last() if self.last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.last else c.asc_nulls_first()

    def after(self, value, forward: bool) -> Column:
        """Rows strictly beyond ``value`` in this key's order."""
        c, beyond_is_null = F.col(self.column), self.last == forward
        if value is None:
            return F.lit(False) if beyond_is_null else c.isNotNull()
        greater = c > F.lit(value) if self.descending != forward else c < F.lit(value)
        return greater | c.isNull() if beyond_is_null else greater


def guard(keys: list[Key], values: list, forward: bool = True) -> Column:
    """Rows after (or before) a position: one branch per key, equal on all keys before it."""
    branches = []
    for i, key in enumerate(keys):
        same = [F.col(k.column).eqNullSafe(F.lit(v)) for k, v in zip(keys[:i], values)]
        branches.append(all_of(*same, key.after(values[i], forward)))
    return any_of(*branches)


_READ = {
    "null": lambda v: None, "bool": bool, "int": int, "float": float, "string": str, "decimal": decimal.Decimal,
    "time": datetime.datetime.fromisoformat, "date": datetime.date.fromisoformat, "bytes": base64.b64decode,
}


def _typed(value) -> tuple[str, object]:
    if value is None:
        return "null", None
    if isinstance(value, bool):
        return "bool", value
    if isinstance(value, (int, float, str)):
        return {int: "int", float: "float", str: "string"}[type(value)], value
    if isinstance(value, decimal.Decimal):
        return "decimal", str(value)
    if isinstance(value, datetime.datetime):
        return "time", value.isoformat()
    if isinstance(value, datetime.date):
        return "date", value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return "bytes", base64.b64encode(value).decode()
    raise TypeError(f"no cursor holds a {type(value).__name__}")


def encode(keys: list[Key], values: list) -> str:
    if len(keys) != len(values):
        raise ValueError(f"{len(keys)} keys, {len(values)} values")
    body = [[k.column, *_typed(v)] for k, v in zip(keys, values)]
    return base64.urlsafe_b64encode(json.dumps(body, separators=(",", ":")).encode()).decode().rstrip("=")


def decode(keys: list[Key], cursor: str) -> list:
    """The values of a cursor made for the same keys; anything else is an error."""
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        values = [_READ[kind](v) for _, kind, v in body]
        if [c for c, _, _ in body] != [k.column for k in keys]:
            raise ValueError("other keys")
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"not a cursor of these keys: {e}") from None
    return values


@dataclass(frozen=True)
class Page:
    items: list[Row]
    has_more: bool
    next_cursor: str | None


def page_frame(df: DataFrame, keys: list[Key], limit: int, cursor: str | None = None, forward: bool = True) -> DataFrame:
    """One row more than a page holds, in order; only ``limit`` + 1 rows leave each task."""
    if not keys:
        raise ValueError("a page needs an order")
    if cursor:
        df = df.filter(guard(keys, decode(keys, cursor), forward))
    order = [k.order() for k in keys] if forward else [Key(k.column, not k.descending, not k.last).order() for k in keys]
    return df.orderBy(*order).limit(limit + 1)


def page(df: DataFrame, keys: list[Key], limit: int, cursor: str | None = None) -> Page:
    rows = page_frame(df, keys, limit, cursor).collect()
    more, items = len(rows) > limit, rows[:limit]
    return Page(items, more, encode(keys, [items[-1][k.column] for k in keys]) if more else None)


def ceiling(df: DataFrame, asked: int | None = None, budget: int | None = None) -> DataFrame:
    """At most as many rows as the tighter of what was asked for and what a reader may have; None is no limit."""
    limits = [x for x in (asked, budget) if x is not None]
    if any(x < 0 for x in limits):
        raise ValueError("a limit is not negative")
    return df.limit(min(limits)) if limits else df
