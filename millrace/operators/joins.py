"""Joins that Spark has no keyword for: ANY, as-of, interval; and quantified subqueries as semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``, which must be total. Spark's window group limit keeps one row per key and task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def any_join(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Inner join with at most one match per left row: the right row that is first in ``order`` for its key."""
    return left.join(first_per_key(right, keys, order), keys)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, tie: str, period: str = "day", how: str = "inner") -> DataFrame:
    """Each left row with the latest right row of its keys at or before its time; of equal times that of the largest ``tie``.

    Rows are dealt by key and ``period``, and each period starts with the last right row before it,
    found among one row per key and period. A key with a third of all rows thus spreads over its
    periods, and no pair is formed. Both sides' columns must have different names but for ``keys``.
    ``how`` is inner or left; left rows with a NULL key or time have no match.
    """
    bucket = lambda c: F.date_trunc(period, F.col(c).cast("timestamp"))
    payload = [c for c in right.columns if c not in keys]
    own = right.dropna(subset=[right_time, *keys])
    packed = own.select(*keys, bucket(right_time).alias("_p"), F.struct(F.col(right_time).alias("_t"), F.col(tie).alias("_i"), *[F.col(c) for c in payload]).alias("_r"))
    lasts = packed.groupBy(*keys, "_p").agg(F.max("_r").alias("_last"))
    asked = left.select(*keys, bucket(time).alias("_p")).distinct()
    ordered = Window.partitionBy(*keys).orderBy("_p", F.col("_last").isNull())
    every = lasts.unionByName(asked.withColumn("_last", F.lit(None).cast(lasts.schema["_last"].dataType)), allowMissingColumns=True)
    per_period = every.groupBy(*keys, "_p").agg(F.max("_last").alias("_last"))
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    carried = per_period.select(*keys, "_p", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    rows = left.select(*keys, bucket(time).alias("_p"), F.col(time).cast("timestamp").alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    others = packed.select(*keys, "_p", F.col("_r._t").cast("timestamp").alias("_at"), F.lit(0).alias("_side"), "_r")
    both = rows.unionByName(others, allowMissingColumns=True)
    within = Window.partitionBy(*keys, "_p").orderBy("_at", "_side", F.col("_r._i")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_m", F.last("_r", ignorenulls=True).over(within)).filter("_side = 1")
    joined = found.join(carried, [*keys, "_p"], "left").withColumn("_m", F.coalesce("_m", "_carry"))
    if how == "inner":
        joined = joined.filter("_m is not null")
    return joined.select(*[F.col(f"_l.{c}").alias(c) for c in left.columns], *[F.col(f"_m.{c}").alias(c) for c in payload])


#: Slots of one level that an interval may touch; longer ones go to a level with slots as many times as wide.
_SLOTS = 32


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, begin: str, end: str, seconds: int) -> DataFrame:
    """Left rows with every right row of their keys whose [begin, end] holds their time.

    Both sides are dealt by key and time slot of ``seconds``; a right row stands in each slot that it
    touches. An interval that would touch many goes to a level of wider slots, so each stands in a few
    dozen at most, and a left row stands once in each level that there is. Intervals that end before
    they begin, or have no end, hold nothing.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    wide = lambda level: F.lit(seconds * 1_000_000) * F.pow(F.lit(_SLOTS), level).cast("long")
    span = (micros(end) - micros(begin)) / F.lit(seconds * 1_000_000)
    level = F.greatest(F.ceil(F.log(F.greatest(span, F.lit(1.0))) / F.log(F.lit(float(_SLOTS)))) - 1, F.lit(0)).cast("int")
    own = right.filter(F.col(begin) <= F.col(end)).withColumn("_level", level)
    # Five levels of days are a hundred thousand years.
    levels = [r[0] for r in own.select("_level").distinct().orderBy("_level").limit(16).collect()]
    there = own.withColumn("_slot", F.explode(F.sequence(F.floor(micros(begin) / wide(F.col("_level"))), F.floor(micros(end) / wide(F.col("_level"))))))
    here = left.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_slot", F.floor(micros(time) / wide(F.col("_level"))))
    return here.join(there, [*keys, "_level", "_slot"]).filter(F.col(time).between(F.col(begin), F.col(end))).drop("_slot", "_level")


def exists(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_semi")


def not_exists(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_anti")


def not_in(left: DataFrame, value: str, right: DataFrame, other: str) -> DataFrame:
    """Rows whose value is NOT IN ``other``: all for no rows there, none with a NULL among them, never a NULL value otherwise.

    One aggregate row decides about NULLs, so the rest is an ordinary anti join of any size.
    """
    facts = right.agg(F.count("*").alias("_n"), F.count(other).alias("_known"))
    keys = right.select(F.col(other).alias("_other")).filter("_other is not null").distinct()
    rows = left.crossJoin(F.broadcast(facts)).filter((F.col("_n") == 0) | ((F.col("_n") == F.col("_known")) & F.col(value).isNotNull()))
    return rows.join(keys, F.col(value) == F.col("_other"), "left_anti").select(*left.columns)


def at_least_all(left: DataFrame, value: str, right: DataFrame, other: str) -> DataFrame:
    """Rows whose value >= ALL of ``other``: one aggregate row decides. TRUE for no rows, never with a NULL among them."""
    bound = right.agg(F.max(other).alias("_most"), F.count("*").alias("_n"), F.count(other).alias("_known"))
    return left.crossJoin(F.broadcast(bound)).filter((F.col("_n") == 0) | ((F.col("_n") == F.col("_known")) & (F.col(value) >= F.col("_most")))).select(*left.columns)
