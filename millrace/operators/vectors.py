"""Vector similarity: distances as JVM expressions, portable filters, search, recommend, scroll."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.predicates import all_of, any_of


def _doubles(v) -> Column:
    return v.cast("array<double>") if isinstance(v, Column) else F.array(*[F.lit(float(x)) for x in v])


def _folded(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def l2(a, b) -> Column:
    return F.sqrt(_folded(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)))


def l1(a, b) -> Column:
    return _folded(_doubles(a), _doubles(b), lambda x, y: F.abs(x - y))


def inner_product(a, b) -> Column:
    """Negated, so that nearer is smaller."""
    return -_folded(_doubles(a), _doubles(b), lambda x, y: x * y)


def cosine(a, b) -> Column:
    a, b = _doubles(a), _doubles(b)
    norm = F.sqrt(_folded(a, a, lambda x, y: x * y)) * F.sqrt(_folded(b, b, lambda x, y: x * y))
    return F.lit(1.0) - _folded(a, b, lambda x, y: x * y) / F.nullif(norm, F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    """Over arrays of booleans."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x)).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.filter(F.zip_with(a, b, lambda x, y: x & y), lambda x: x))
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: x | y), lambda x: x))
    return F.when(either == 0, F.lit(0.0)).otherwise(F.lit(1.0) - both / either)


METRICS = {"l2": l2, "l1": l1, "ip": inner_product, "cosine": cosine}


def score(metric: str, distance: Column) -> Column:
    return F.lit(1.0) - distance if metric == "cosine" else -distance


def ne(field: Column, value) -> Column:
    """Also matches NULL, unlike SQL."""
    return field.isNull() | (field != F.lit(value))


def not_in(field: Column, values: Iterable) -> Column:
    own = list(values)
    return field.isNull() | ~field.isin(own) if own else F.lit(True)


def matching(*filters: Column | None) -> Column | None:
    """All hold; nothing given is no constraint."""
    own = [f for f in filters if f is not None]
    return all_of(*own) if own else None


def matching_any(*filters: Column | None) -> Column | None:
    """One holds; nothing given is no constraint."""
    own = [f for f in filters if f is not None]
    return any_of(*own) if own else None


def within_text(field: Column, text: str) -> Column:
    return F.lower(field).contains(text.lower())


def search(df: DataFrame, id: str, vector: str, query, k: int, metric: str = "cosine", where: Column | None = None, most: float | None = None, after: tuple[float, int] | None = None) -> DataFrame:
    """The k nearest rows in order of (distance, id), exactly: each task keeps k.

    ``most`` bounds the distance; ``after`` is the last (distance, id) of the page before.
    """
    own = df if where is None else df.filter(where)
    own = own.filter(F.col(vector).isNotNull()).withColumn("distance", METRICS[metric](F.col(vector), query)).filter("distance is not null")
    if most is not None:
        own = own.filter(F.col("distance") <= most)
    if after is not None:
        d, i = after
        own = own.filter((F.col("distance") > d) | ((F.col("distance") == d) & (F.col(id) > i)))
    return own.orderBy("distance", id).limit(k)


def recommend(df: DataFrame, id: str, vector: str, positive: list, negative: list, k: int, metric: str = "cosine") -> DataFrame:
    """The k nearest to avg(positive) + (avg(positive) - avg(negative)); the examples themselves are left out.

    The examples are a handful of ids; their mean is one row that joins every row.
    """
    width = F.size(vector)
    examples = df.filter(F.col(id).isin([*positive, *negative])).select(F.col(id).isin(positive).alias("good"), F.posexplode(_doubles(F.col(vector))).alias("i", "x"))
    means = examples.groupBy("i").agg(F.avg(F.when(F.col("good"), F.col("x"))).alias("p"), F.avg(F.when(~F.col("good"), F.col("x"))).alias("n"))
    aim = F.when(F.col("n").isNull(), F.col("p")).otherwise(2 * F.col("p") - F.col("n"))
    target = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", aim.alias("x")))), lambda e: e["x"]).alias("_target"))
    rest = df.filter(~F.col(id).isin([*positive, *negative])).filter(width > 0).crossJoin(F.broadcast(target))
    return rest.withColumn("distance", METRICS[metric](F.col(vector), F.col("_target"))).drop("_target").orderBy("distance", id).limit(k)


def scroll(df: DataFrame, id: str, limit: int, after: int | None = None, where: Column | None = None) -> DataFrame:
    own = df if where is None else df.filter(where)
    return (own if after is None else own.filter(F.col(id) > after)).orderBy(id).limit(limit)


def literal(vector: Iterable[float]) -> str:
    return "[" + ",".join(f"{x:g}" for x in vector) + "]"


def parse(text: str) -> list[float]:
    return [float(x) for x in text.strip("[] ").split(",") if x.strip()]


def from_text(text: Column) -> Column:
    """``[1,2.5]`` as an array of doubles; NULL for what is none."""
    inner = F.trim(F.regexp_extract(text, r"^\s*\[(.*)\]\s*$", 1))
    parts = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ","))
    return F.when(F.regexp_like(text, F.lit(r"^\s*\[.*\]\s*$")), F.transform(parts, lambda x: F.trim(x).try_cast("double")))
