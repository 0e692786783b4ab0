"""Estimates with a bound: each is compared with the exact value, so its SQL twin says which groups are near."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import aggregates as a
from millrace.plans.registry import query

c = F.col


def _within(estimate, exact, share: float):
    return F.abs(estimate - exact) <= F.greatest(exact * share, F.lit(2))


@query("SELECT l_returnflag, true AS parts_near, true AS hll_near FROM lineitem GROUP BY 1")
def approx_distinct_within(t):
    """Three standard errors: 5 % for the default, 5 % for 4,096 registers.

    The exact count stands apart: beside it, Spark would keep both sketches for every distinct value of a group.
    """
    estimated = t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.0166).alias("u"), a.uniq_hll(c("l_partkey")).alias("h"))
    exact = t.lineitem.groupBy(c("l_returnflag").alias("flag")).agg(F.count_distinct("l_partkey").alias("exact"))
    found = estimated.join(exact, c("l_returnflag").eqNullSafe(c("flag")))
    return found.select("l_returnflag", _within(c("u"), c("exact"), 0.05).alias("parts_near"), _within(c("h"), c("exact"), 0.05).alias("hll_near"))


@query("SELECT event_type, true AS near FROM events GROUP BY 1")
def aggregating_states_within(t):
    """States of days merge to the estimate of the whole."""
    daily = t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.hll_sketch_agg("user_id", F.lit(12)).alias("users"))
    merged = daily.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"))
    exact = t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    return merged.join(exact, "event_type").select("event_type", _within(c("users"), c("exact"), 0.05).alias("near"))


@query("SELECT l_returnflag, true AS near FROM lineitem GROUP BY 1")
def sample_fraction_within(t):
    """A tenth of the rows of each flag, by five standard deviations."""
    rows = t.lineitem.select("l_returnflag", F.lit(0).alias("taken")).unionByName(t.lineitem.sample(0.1, seed=7).select("l_returnflag", F.lit(1).alias("taken")))
    counted = rows.groupBy("l_returnflag").agg(F.sum("taken").alias("taken"), F.count_if(c("taken") == 0).alias("all"))
    return counted.select("l_returnflag", (F.abs(c("taken") - 0.1 * c("all")) <= 5 * F.sqrt(0.09 * c("all")) + 1).alias("near"))


@query("SELECT event_type, true AS near FROM events GROUP BY 1")
def quantile_approximate_within(t):
    """The share of values up to the estimate is the one asked for, to one in a hundred."""
    found = t.events.groupBy("event_type").agg(F.percentile_approx("value", 0.9, 10_000).alias("p90"))
    shares = t.events.join(F.broadcast(found), "event_type").groupBy("event_type").agg(F.avg((c("value") <= c("p90")).cast("double")).alias("up_to"), F.count("*").alias("n"))
    return shares.select("event_type", (F.abs(c("up_to") - 0.9) <= 0.01 + 1 / c("n")).alias("near"))


@query("SELECT o_custkey, true AS any_is_there, true AS last_is_there FROM orders GROUP BY 1")
def any_and_last_within(t):
    """Any value, and the last one met, are values of the group."""
    found = t.orders.groupBy("o_custkey").agg(F.any_value("o_orderkey").alias("one"), F.last("o_orderkey").alias("last"), F.collect_set("o_orderkey").alias("every"))
    return found.select("o_custkey", F.array_contains("every", c("one")).alias("any_is_there"), F.array_contains("every", c("last")).alias("last_is_there"))
