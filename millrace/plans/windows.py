"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import windows as w
from millrace.operators.windows import END, HERE, START, lag_in_frame, lead_in_frame, over
from millrace.plans.registry import query

c = F.col
_BY_CUSTOMER = (["o_custkey"], ["o_orderdate", "o_orderkey"])


def _orders(t, **columns):
    return t.orders.select("o_orderkey", *[v.alias(k) for k, v in columns.items()])


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS rn, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dr FROM part")
def rank_family(t):
    by_size = over(["p_brand"], [c("p_size")])
    return t.part.select("p_partkey", F.row_number().over(over(["p_brand"], [c("p_size"), c("p_partkey")])).cast("long").alias("rn"), F.rank().over(by_size).cast("long").alias("r"), F.dense_rank().over(by_size).cast("long").alias("dr"))


@query("SELECT s_suppkey, ntile(4) OVER w AS quarter, round(cume_dist() OVER w, 9) AS cume, round(percent_rank() OVER w, 9) AS pct FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)")
def ntile_cume_percent(t):
    w = over(["s_nationkey"], [c("s_acctbal"), c("s_suppkey")])
    return t.supplier.select("s_suppkey", F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.cume_dist().over(w), 9).alias("cume"), F.round(F.percent_rank().over(w), 9).alias("pct"))


@query("SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2, -1.0) OVER w AS later FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def lag_lead_default(t):
    w = over(*_BY_CUSTOMER)
    return _orders(t, before=F.lag("o_totalprice").over(w), later=F.lead("o_totalprice", 2, -1.0).over(w))


@query("SELECT o_orderkey, coalesce(lag(o_totalprice, 2) OVER w, 0.0) AS before, coalesce(lead(o_totalprice, 1) OVER w, 0.0) AS later FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def lag_lead_in_frame(t):
    w = over(*_BY_CUSTOMER)
    return _orders(t, before=lag_in_frame(c("o_totalprice"), w, 2, F.lit(0.0)), later=lead_in_frame(c("o_totalprice"), w, 1, F.lit(0.0)))


@query("""SELECT o_orderkey, first_value(o_orderkey) OVER w AS first, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last,
    nth_value(o_orderkey, 3) OVER w AS third FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def first_last_nth(t):
    w = over(*_BY_CUSTOMER)
    return _orders(t, first=F.first_value("o_orderkey").over(w), last=F.last_value("o_orderkey").over(over(*_BY_CUSTOMER, rows=(START, END))), third=F.nth_value("o_orderkey", 3).over(w))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS near, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead FROM orders")
def frame_rows(t):
    return _orders(t, near=F.round(F.sum("o_totalprice").over(over(*_BY_CUSTOMER, rows=(-2, HERE))), 2), ahead=F.count("*").over(over(*_BY_CUSTOMER, rows=(1, 3))))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS alike FROM part")
def frame_range(t):
    return t.part.select("p_partkey", F.count("*").over(over(["p_brand"], [c("p_size")], values=(-5, 5))).alias("alike"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 9) AS share FROM orders")
def agg_over(t):
    return _orders(t, running=F.round(F.sum("o_totalprice").over(over(*_BY_CUSTOMER)), 2), share=F.round(c("o_totalprice") / F.sum("o_totalprice").over(over(["o_custkey"], [])), 9))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn > 1 AND rn <= 3")
def per_parent_limit(t):
    from millrace.operators.relations import limited_per_parent

    rows = t.orders.withColumn("_key", c("o_custkey"))
    return limited_per_parent(rows, [c("o_totalprice").desc(), c("o_orderkey")], 2, 1).select("o_custkey", "o_orderkey")


@query("SELECT user_id, min(ts) AS begin, max(ts) AS finish, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS visit FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, visit")
def sessions(t):
    w = over(["user_id"], [c("ts"), c("event_id")])
    gap = F.unix_micros(c("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    visits = t.events.withColumn("fresh", F.when(gap <= 6 * 3_600_000_000, 0).otherwise(1)).withColumn("visit", F.sum("fresh").over(w.rowsBetween(START, HERE)))
    return visits.groupBy("user_id", "visit").agg(F.min("ts").alias("begin"), F.max("ts").alias("finish"), F.count("*").alias("n")).drop("visit")


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS near, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW)")
def frame_groups(t):
    rows, frame = w.grouped_frame(t.orders, ["o_custkey"], [c("o_orderstatus")], -1, 0)
    return rows.select("o_orderkey", F.round(F.sum("o_totalprice").over(frame), 2).alias("near"), F.count("*").over(frame).alias("n"))


@query("SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW)::BIGINT AS others FROM orders")
def frame_exclude_current(t):
    return t.orders.select("o_orderkey", w.sum_but_current(c("o_orderkey"), ["o_custkey"], [c("o_orderdate"), c("o_orderkey")], -2, 1).alias("others"))
