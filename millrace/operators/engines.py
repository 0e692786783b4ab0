"""Reads over append-only tables that collapse on merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replacing(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Per key the row of the largest ``version`` (a total order). A grouped maximum: map-side combined, no sort by key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def summing(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per key the sums of ``columns``; of the others any value."""
    rest = [c for c in df.columns if c not in keys and c not in columns]
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns], *[F.any_value(c).alias(c) for c in rest])


def collapsing(df: DataFrame, keys: list[str], sign: str) -> DataFrame:
    """Keys whose signs add up to more than 0, with the sum."""
    return df.groupBy(*keys).agg(F.sum(sign).alias(sign)).filter(F.col(sign) > 0)


def collapsing_rows(df: DataFrame, keys: list[str], sign: str, order: list[str]) -> DataFrame:
    """The row that survives per key whose signs add up to more than 0: the last positive one in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.when(F.col(sign) > 0, F.struct(*rest)), F.when(F.col(sign) > 0, F.struct(*order)))
    best = df.groupBy(*keys).agg(F.sum(sign).alias("_sum"), last.alias("_row")).filter("_sum > 0")
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def versioned_collapsing(df: DataFrame, keys: list[str], version: str, sign: str) -> DataFrame:
    return collapsing(df, [*keys, version], sign)


def aggregating(df: DataFrame, keys: list[str], states: list[str]) -> DataFrame:
    """Merge HyperLogLog states per key."""
    return df.groupBy(*keys).agg(*[F.hll_union_agg(s).alias(s) for s in states])


def sampled_by_key(df: DataFrame, key: Column, parts: int, take: int) -> DataFrame:
    """The same share of keys in every table that has the key."""
    return df.filter(F.pmod(key, F.lit(parts)) < take)
