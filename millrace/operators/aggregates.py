"""Aggregates whose names or NULL rules differ between dialects."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.tables import numbered


def filtered(aggregate, value: Column, predicate: Column) -> Column:
    """aggregate(value) FILTER (WHERE predicate): NULL, or 0 for counts, where nothing matches."""
    return aggregate(F.when(predicate, value))


def sum_if(predicate: Column, value: Column) -> Column:
    """NULL where nothing matches."""
    return F.sum(F.when(predicate, value))


def total(value: Column) -> Column:
    """Sum as double; 0.0 for no rows."""
    return F.coalesce(F.sum(value.cast("double")), F.lit(0.0))


def array_agg(value: Column, keep_nulls: bool = True) -> Column:
    """Values as an array; ``keep_nulls`` as in PostgreSQL, without as groupArray. Order is not defined: sort the result."""
    return F.transform(F.collect_list(F.struct(value.alias("v"))), lambda x: x["v"]) if keep_nulls else F.collect_list(value)


def uniq_array(value: Column) -> Column:
    return F.sort_array(F.collect_set(value))


def group_concat(value: Column, order: Column, separator: str = ",") -> Column:
    """Non-NULL values in ``order``, joined; ``order`` must be total."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.nullif(F.array_join(F.transform(pairs, lambda x: x["v"].cast("string")), separator), F.lit(""))


def json_array(value: Column, order: Column) -> Column:
    return F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]))


def json_object(key: Column, value: Column) -> Column:
    """Keys in order; of equal keys the largest value stays."""
    entries = F.array_sort(F.collect_set(F.struct(key.alias("k"), value.alias("v"))))
    last = F.filter(entries, lambda e, i: (i == F.size(entries) - 1) | (F.get(entries, i + 1)["k"] != e["k"]))
    return F.to_json(F.map_from_entries(last))


def arg_max(value: Column, by: Column, tie: Column) -> Column:
    """``value`` of the row of the largest ``by``; of equals that of the largest ``tie``."""
    return F.max_by(value, F.struct(by, tie))


def arg_min(value: Column, by: Column, tie: Column) -> Column:
    return F.min_by(value, F.struct(by, tie))


def uniq_hll(value: Column, lg_config: int = 12) -> Column:
    """Approximate distinct count by a HyperLogLog sketch of 2**lg_config registers."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(value, F.lit(lg_config)))


def any_heavy(value: Column) -> Column:
    """The most frequent value; of equals the smallest."""
    return F.mode(value, True)


def quantiles(df: DataFrame, groups: list[str], value: str, wanted: Mapping[str, float], discrete: bool = False) -> DataFrame:
    """Exact quantiles of any group size: the groups, one column for each of ``wanted`` (name to probability), and ``n``, the values.

    Rows are sorted by range and numbered, and the places asked for are joined by number, so no task
    holds a group. ``discrete`` takes the first value with at least that share at or below it, else
    neighbours are interpolated. NULL values don't count; a group without others is missing.
    """
    ranked = numbered(df.select(*groups, F.col(value).alias("_v")).filter("_v is not null"), "_n", [*groups, "_v"], 0)
    sizes = ranked.groupBy(*groups).agg(F.min("_n").alias("_first"), F.count("*").alias("n"))
    n, places = F.col("n"), []
    for name, p in wanted.items():
        at = F.greatest(F.ceil(n * p) - 1, F.lit(0)).cast("double") if discrete else (n - 1) * p
        for place in (F.floor(at), F.ceil(at)):
            places.append(F.struct(F.lit(name).alias("name"), (F.col("_first") + place.cast("long")).alias("place"), (at - F.floor(at)).alias("beyond")))
    asked = sizes.select(*groups, "n", F.explode(F.array(*places)).alias("_a")).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "n", "_a.*")
    found = asked.join(ranked.select("_n", "_v"), F.col("place") == F.col("_n"))

    def value_of(name: str) -> Column:
        own = F.when(F.col("name") == name, F.col("_v"))
        return F.min(own) if discrete else F.min(own) + (F.max(own) - F.min(own)) * F.max(F.when(F.col("name") == name, F.col("beyond")))

    out = found.groupBy(*[f"_g{i}" for i in range(len(groups))], "n").agg(*[value_of(name).alias(name) for name in wanted])
    return out.select(*[F.col(f"_g{i}").alias(g) for i, g in enumerate(groups)], *wanted, "n")


def timing(value: Column) -> Column:
    """Milliseconds as timing quantiles take them: whole up to 1,024, then multiples of 16, 30,000 at most."""
    ms = F.least(F.greatest(F.floor(value), F.lit(0)), F.lit(30_000))
    return F.when(ms < 1024, ms).otherwise(F.floor(ms / 16) * 16).cast("long")


def quantile_timing(df: DataFrame, groups: list[str], value: str, probability: float, name: str) -> DataFrame:
    """A quantile of timings: rows become counts of some three thousand classes before they are ranked."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, timing(F.col(value)).alias("_ms")).agg(F.count("*").alias("_n"))
    up_to = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_ms").rowsBetween(Window.unboundedPreceding, 0))
    every = F.sum("_n").over(Window.partitionBy(*groups))
    return counts.withColumn("_up", up_to).withColumn("_all", every).filter(F.col("_up") >= F.ceil(F.col("_all") * probability)).groupBy(*groups).agg(F.min("_ms").alias(name))
