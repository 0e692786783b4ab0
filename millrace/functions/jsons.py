"""JSON text functions. What Spark can express stays in the JVM; recursive containment and path
mutation, which it cannot, are Arrow-batched functions over a small per-value helper."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType


def path(*keys: str | int) -> str:
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else f"['{k}']" for k in keys)


def get_text(doc: Column, *keys: str | int) -> Column:
    """A member as text; NULL for a missing member and for JSON null."""
    return F.get_json_object(doc, path(*keys))


def get(doc: Column, *keys: str | int) -> Column:
    """A member as JSON; JSON null is the text null."""
    return F.to_json(F.try_variant_get(F.try_parse_json(doc), path(*keys), "variant"))


def typed(doc: Column, kind: str, *keys: str | int) -> Column:
    """A member cast to ``kind``; NULL where it is missing or doesn't fit."""
    return get_text(doc, *keys).try_cast(kind)


def has_key(doc: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(doc), key), F.lit(False))


def has_any_key(doc: Column, keys: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.json_object_keys(doc), F.array(*map(F.lit, keys))), F.lit(False))


def has_all_keys(doc: Column, keys: list[str]) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, keys)), F.json_object_keys(doc))) == 0, F.lit(False))


def merge_shallow(a: Column, b: Column) -> Column:
    """b's members over a's, in the order of their names; members of JSON null stay."""
    old, new = _members(F.try_parse_json(a)), _members(F.try_parse_json(b))
    return F.to_json(F.to_variant_object(F.map_concat(F.map_filter(old, lambda name, _: ~F.map_contains_key(new, name)), new)))


def kind(doc: Column) -> Column:
    """object, array, string, number, boolean or null; NULL for text that is no JSON."""
    name = F.schema_of_variant(F.try_parse_json(doc))
    return (
        F.when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null")
        .when(name.isNotNull(), "number")
    )


def array_length(doc: Column) -> Column:
    return F.json_array_length(doc)


def build_object(**members: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in members.items()]), {"ignoreNullFields": "false"})


def build_array(*values: Column) -> Column:
    return F.to_json(F.array(*values), {"ignoreNullFields": "false"})


def strip_nulls(doc: Column) -> Column:
    def strip(x):
        if isinstance(x, dict):
            return {k: strip(v) for k, v in x.items() if v is not None}
        return [strip(v) for v in x] if isinstance(x, list) else x

    return _text(lambda x: _dump(strip(x)))(doc)


def contains(doc: Column, part: Column) -> Column:
    """Structural containment at any depth of nested members: objects by key, arrays as sets, scalars by value."""

    def within(a, b) -> bool:
        if isinstance(b, dict):
            return isinstance(a, dict) and all(k in a and within(a[k], v) for k, v in b.items())
        if isinstance(b, list):
            return isinstance(a, list) and all(any(within(x, y) for x in a) for y in b)
        if isinstance(a, list):
            return any(not isinstance(x, (dict, list)) and within(x, b) for x in a)
        return type(a) is type(b) and a == b or (not isinstance(a, bool) and not isinstance(b, bool) and isinstance(a, (int, float)) and isinstance(b, (int, float)) and a == b)

    return _arrow(within, BooleanType())(doc, part)


def merge_patch(doc: Column, patch: Column) -> Column:
    """RFC 7396: members of null delete."""

    def patched(a, b):
        if not isinstance(b, dict):
            return b
        out = dict(a) if isinstance(a, dict) else {}
        for k, v in b.items():
            if v is None:
                out.pop(k, None)
            else:
                out[k] = patched(out.get(k), v)
        return out

    return _text(lambda a, b: _dump(patched(a, b)))(doc, patch)


def _members(value: Column) -> Column:
    """An object's members as a map of variants; NULL for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _elements(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _put(x: Column, at: list[str | int], v: Column, create: bool, replace: bool) -> Column:
    if not at:
        return v if replace else x
    k, rest = at[0], at[1:]
    if isinstance(k, str):
        old = _members(x)
        others = F.map_filter(old, lambda name, _: name != k)
        with_new = lambda value: F.to_variant_object(F.map_concat(others, F.create_map(F.lit(k), value)))
        out = F.when(F.map_contains_key(old, F.lit(k)), with_new(_put(F.try_element_at(old, F.lit(k)), rest, v, create, replace)))
        if create and not rest:
            out = out.when(old.isNotNull(), with_new(v))
    else:
        old = _elements(x)
        place = F.lit(k) if k >= 0 else F.size(old) + k
        moved = F.transform(old, lambda e, i: F.when(i == place, _put(e, rest, v, create, replace)).otherwise(e))
        out = F.when((place >= 0) & (place < F.size(old)), F.to_variant_object(moved))
        if create and not rest:
            out = out.when(old.isNotNull(), F.to_variant_object(F.array_append(old, v)))
    return out.otherwise(x)


def set_path(doc: Column, keys: list[str | int], value: Column, create: bool = True, replace: bool = True) -> Column:
    """``value`` (JSON) at a path: set, insert (``replace`` False) or replace (``create`` False). Members come out in the order of their names."""
    x, v = F.try_parse_json(doc), F.try_parse_json(value)
    return F.when(x.isNotNull() & v.isNotNull(), F.to_json(_put(x, keys, v, create, replace)))


def _without(x: Column, at: list[str | int]) -> Column:
    k, rest = at[0], at[1:]
    if isinstance(k, str):
        old = _members(x)
        others = F.map_filter(old, lambda name, _: name != k)
        new = F.map_concat(others, F.create_map(F.lit(k), _without(F.try_element_at(old, F.lit(k)), rest))) if rest else others
        return F.when(F.map_contains_key(old, F.lit(k)), F.to_variant_object(new)).otherwise(x)
    old = _elements(x)
    place = F.lit(k) if k >= 0 else F.size(old) + k
    new = F.transform(old, lambda e, i: F.when(i == place, _without(e, rest)).otherwise(e)) if rest else F.filter(old, lambda e, i: i != place)
    return F.when((place >= 0) & (place < F.size(old)), F.to_variant_object(new)).otherwise(x)


def remove_path(doc: Column, keys: list[str | int]) -> Column:
    """Without what stands at a path; members come out in the order of their names."""
    return F.to_json(_without(F.try_parse_json(doc), keys))


def length(doc: Column) -> Column:
    """Elements of an array, members of an object, 1 for a scalar."""
    return F.coalesce(F.json_array_length(doc), F.size(F.json_object_keys(doc)), F.when(kind(doc).isNotNull(), F.lit(1)))


def keys(doc: Column) -> Column:
    return F.json_object_keys(doc)


def overlaps(a: Column, b: Column) -> Column:
    """A common member (key and value), a common element, or equal scalars."""

    def meet(x, y) -> bool:
        if isinstance(x, dict) and isinstance(y, dict):
            return any(k in x and x[k] == v for k, v in y.items())
        return any(i == j for i in (x if isinstance(x, list) else [x]) for j in (y if isinstance(y, list) else [y]))

    return _arrow(meet, BooleanType())(a, b)


def merge_preserve(a: Column, b: Column) -> Column:
    """Objects merge member by member, everything else is joined into an array."""

    def merged(x, y):
        if isinstance(x, dict) and isinstance(y, dict):
            return {**x, **{k: merged(x[k], v) if k in x else v for k, v in y.items()}}
        return [*(x if isinstance(x, list) else [x]), *(y if isinstance(y, list) else [y])]

    return _text(lambda x, y: _dump(merged(x, y)))(a, b)


def depth(doc: Column) -> Column:
    """1 for a scalar or an empty container."""

    def deep(x) -> int:
        inner = list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
        return 1 + max(map(deep, inner), default=0)

    return _arrow(deep, IntegerType())(doc)


def search(doc: Column, text: str) -> Column:
    """Paths of all strings equal to ``text``, as a JSON array."""

    def find(x, at: str):
        if isinstance(x, dict):
            return [p for k, v in x.items() for p in find(v, f"{at}.{k}")]
        if isinstance(x, list):
            return [p for i, v in enumerate(x) for p in find(v, f"{at}[{i}]")]
        return [at] if x == text and isinstance(x, str) else []

    return _text(lambda x: _dump(find(x, "$")))(doc)


def pretty(doc: Column) -> Column:
    return _text(lambda x: json.dumps(x, ensure_ascii=False, indent=4))(doc)


def quote(text: Column) -> Column:
    whole = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


def unquote(doc: Column) -> Column:
    return F.get_json_object(doc, "$")


def table(df: DataFrame, doc: str, schema: str) -> DataFrame:
    """One row per element of a JSON array of objects, as columns of ``schema`` (DDL); rows without elements stay."""
    return df.select("*", F.inline_outer(F.from_json(doc, f"array<struct<{schema}>>")))


def _dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _parsed(text):
    if text is None:
        raise ValueError
    return json.loads(text)


def _arrow(function: Callable, kind) -> Callable[..., Column]:
    def one(*texts):
        try:
            return function(*map(_parsed, texts))
        except ValueError:
            return None

    if function.__code__.co_argcount == 1:

        def run(a: pd.Series) -> pd.Series:
            return pd.Series([one(x) for x in a], dtype=object)
    else:

        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)

    return F.pandas_udf(run, kind)


def _text(function: Callable) -> Callable[..., Column]:
    return _arrow(function, StringType())
