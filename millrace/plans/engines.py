"""Collapsing reads, samples, writes as rewrites, places."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import engines as e
from millrace.operators import geo
from millrace.operators import writes as w
from millrace.plans.registry import query

c = F.col


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def final_replacing(t):
    return e.replacing(t.events.select("user_id", "event_id", "value", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("SELECT l_partkey, sum(l_linenumber)::BIGINT AS l_linenumber, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1")
def summing(t):
    return e.summing(t.lineitem.select("l_partkey", "l_linenumber", "l_quantity"), ["l_partkey"], ["l_linenumber", "l_quantity"])


@query("SELECT user_id, sum(CASE WHEN event_type IN ('view', 'signup') THEN 1 ELSE -1 END)::BIGINT AS sign FROM events GROUP BY 1 HAVING sum(CASE WHEN event_type IN ('view', 'signup') THEN 1 ELSE -1 END) > 0")
def collapsing(t):
    signed = t.events.withColumn("sign", F.when(c("event_type").isin("view", "signup"), 1).otherwise(-1))
    return e.collapsing(signed, ["user_id"], "sign")


@query("SELECT user_id, day(ts)::INTEGER AS version, sum(CASE WHEN event_type IN ('view', 'signup') THEN 1 ELSE -1 END)::BIGINT AS sign FROM events GROUP BY 1, 2 HAVING sum(CASE WHEN event_type IN ('view', 'signup') THEN 1 ELSE -1 END) > 0")
def versioned_collapsing(t):
    signed = t.events.select("user_id", F.day("ts").alias("version"), F.when(c("event_type").isin("view", "signup"), 1).otherwise(-1).alias("sign"))
    return e.versioned_collapsing(signed, ["user_id"], "version", "sign")


@query()
def aggregating_states(t):
    daily = t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.hll_sketch_agg("user_id", F.lit(12)).alias("users"))
    return e.aggregating(daily, ["event_type"], ["users"]).select("event_type", F.hll_sketch_estimate("users").alias("users"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 10 < 2")
def sample_hash(t):
    return e.sampled_by_key(t.orders, c("o_custkey"), 10, 2).select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_returnflag = 'R'")
def prewhere(t):
    early = t.lineitem.filter(c("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    return early.filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")


@query("""SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN b.c_acctbal WHEN b.c_custkey IS NOT NULL AND b.c_acctbal > a.c_acctbal THEN b.c_acctbal ELSE a.c_acctbal END AS c_acctbal
    FROM (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') a FULL JOIN (SELECT c_custkey, c_acctbal + c_custkey % 7 - 3 AS c_acctbal FROM customer WHERE c_acctbal > 3000) b ON a.c_custkey = b.c_custkey""")
def upsert_merge(t):
    old = t.customer.filter("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_acctbal")
    new = t.customer.filter("c_acctbal > 3000").select("c_custkey", (c("c_acctbal") + c("c_custkey") % 7 - 3).alias("c_acctbal"))
    return w.upsert(old, new, ["c_custkey"], {"c_acctbal": c("excluded.c_acctbal")}, where=c("excluded.c_acctbal") > c("t.c_acctbal"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 3000")
def upsert_do_nothing(t):
    old = t.customer.filter("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_nationkey")
    return w.upsert(old, t.customer.filter("c_acctbal > 3000").select("c_custkey", F.lit(-1).alias("c_nationkey")), ["c_custkey"])


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.there THEN CASE WHEN b.there THEN a.c_acctbal + b.c_acctbal ELSE a.c_acctbal END ELSE b.c_acctbal END AS c_acctbal
    FROM (SELECT nullif(c_custkey, 7) AS k, c_acctbal, true AS there FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_custkey = 7) a
    FULL JOIN (SELECT nullif(c_custkey, 7) AS k, c_acctbal + 1 AS c_acctbal, true AS there FROM customer WHERE c_acctbal > 3000 OR c_custkey = 7) b ON a.k IS NOT DISTINCT FROM b.k""")
def upsert_null_key(t):
    own = t.customer.select(F.nullif("c_custkey", F.lit(7)).alias("k"), "c_acctbal", "c_mktsegment")
    old = own.filter((c("c_mktsegment") != "BUILDING") | c("k").isNull()).drop("c_mktsegment")
    new = own.filter((c("c_acctbal") > 3000) | c("k").isNull()).select("k", (c("c_acctbal") + 1).alias("c_acctbal"))
    return w.upsert(old, new, ["k"], {"c_acctbal": c("t.c_acctbal") + c("excluded.c_acctbal")})


@query("SELECT nullif(c_custkey, 7) AS k, c_acctbal, c_custkey = 7 AS kept FROM customer")
def upsert_keeps_a_null_key(t):
    """A stored row with a NULL key that nothing conflicts with keeps its values."""
    old = t.customer.select(F.nullif("c_custkey", F.lit(7)).alias("k"), "c_acctbal", (c("c_custkey") == 7).alias("kept"))
    return w.upsert(old, old.filter("k is not null"), ["k"], {"c_acctbal": c("excluded.c_acctbal")})


@query("SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' AND o_totalprice > 100000 THEN c_mktsegment ELSE o_orderpriority END AS o_orderpriority, CASE WHEN c_mktsegment = 'BUILDING' AND o_totalprice > 100000 THEN o_totalprice - c_acctbal ELSE o_totalprice END AS o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def update_from(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    new = {"o_orderpriority": c("s.c_mktsegment"), "o_totalprice": c("t.o_totalprice") - c("s.c_acctbal")}
    return w.update_from(orders, t.customer, {"o_custkey": "c_custkey"}, new, (c("s.c_mktsegment") == "BUILDING") & (c("t.o_totalprice") > 100000)).drop("o_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_extendedprice > o_totalprice / 10)")
def delete_using(t):
    bad = t.lineitem.filter("l_returnflag = 'R'")
    return w.delete_using(t.orders, bad, (c("t.o_orderkey") == c("s.l_orderkey")) & (c("s.l_extendedprice") > c("t.o_totalprice") / 10)).select("o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN NOT o_totalprice < 250000 THEN 'price' END, CASE WHEN NOT coalesce(nullif(o_orderstatus, 'P') IN ('O', 'F'), false) THEN 'status' END, CASE WHEN NOT o_orderpriority LIKE '%-%' THEN 'priority' END) AS faults
    FROM orders WHERE NOT (o_totalprice < 250000 AND coalesce(nullif(o_orderstatus, 'P') IN ('O', 'F'), false) AND o_orderpriority LIKE '%-%')""")
def validated_rows(t):
    rules = {"price": c("o_totalprice") < 250000, "status": F.nullif("o_orderstatus", F.lit("P")).isin("O", "F"), "priority": c("o_orderpriority").like("%-%")}
    return w.validated(t.orders, rules)[1].select("o_orderkey", F.array_join("faults", ",").alias("faults"))


@query("""SELECT user_id, arg_max(event_id, event_id) FILTER (WHERE sign = 1) AS event_id, arg_max(value, event_id) FILTER (WHERE sign = 1) AS value
    FROM (SELECT *, CASE WHEN event_type IN ('view', 'signup') THEN 1 ELSE -1 END AS sign FROM events) GROUP BY 1 HAVING sum(sign) > 0""")
def collapsing_rows(t):
    signed = t.events.select("user_id", "event_id", "value", F.when(c("event_type").isin("view", "signup"), 1).otherwise(-1).alias("sign"))
    return e.collapsing_rows(signed, ["user_id"], "sign", ["event_id"]).drop("sign")


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN s_acctbal + 10 ELSE s_acctbal END AS s_acctbal, CASE WHEN s_nationkey = 3 THEN greatest(s_nationkey, 5) ELSE s_nationkey END AS s_nationkey FROM supplier")
def patch_ops(t):
    return w.update(t.supplier, c("s_nationkey") == 3, {"s_acctbal": w.increased("s_acctbal", 10), "s_nationkey": w.set_if_greater("s_nationkey", F.lit(5))}).select("s_suppkey", "s_acctbal", "s_nationkey")


@query("SELECT s_suppkey, s_acctbal * 2 AS s_acctbal FROM supplier WHERE s_nationkey = 4")
def update_returning(t):
    return w.returning(t.supplier, c("s_nationkey") == 4, {"s_acctbal": c("s_acctbal") * 2}, "s_suppkey", "s_acctbal")


@query("SELECT s_suppkey FROM supplier WHERE NOT coalesce(nullif(s_nationkey, 2) > 10, false)")
def delete_rows(t):
    return w.delete(t.supplier, F.nullif("s_nationkey", F.lit(2)) > 10).select("s_suppkey")


@query("SELECT count(*) AS live FROM orders WHERE NOT (o_orderkey % 10 = 0 OR o_orderstatus = 'P')")
def soft_delete(t):
    marked = t.orders.withColumn("deleted_at", F.when(c("o_orderkey") % 10 == 0, F.lit("2020-01-01").cast("timestamp_ntz")))
    gone = w.soft_delete(marked, c("o_orderstatus") == "P", "deleted_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    return gone.filter("deleted_at is null").agg(F.count("*").alias("live"))


@query("SELECT s_suppkey, s_name, NULL::INTEGER AS s_nationkey FROM supplier UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def insert_rows(t):
    supplier = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    return w.insert(supplier, supplier.drop("s_nationkey"))


_PLACES = "SELECT c_custkey, (c_custkey * 37 % 1800) / 10.0 - 90 AS lat, (c_custkey * 91 % 3600) / 10.0 - 180 AS lon FROM customer"
_METRES = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians((lat - 45.0) / 2)), 2) + cos(radians(lat)) * cos(radians(45.0)) * pow(sin(radians((lon - 9.0) / 2)), 2))))"


def _places(t):
    return t.customer.select("c_custkey", ((c("c_custkey") * 37 % 1800) / 10.0 - 90).alias("lat"), ((c("c_custkey") * 91 % 3600) / 10.0 - 180).alias("lon"))


@query(f"SELECT c_custkey FROM ({_PLACES}) WHERE lat > 30 AND lat < 60 AND lon > -10 AND lon < 40")
def geo_within_box(t):
    return _places(t).filter(geo.within_box(c("lat"), c("lon"), 30, -10, 60, 40)).select("c_custkey")


@query(f"SELECT c_custkey, round({_METRES}, 2) AS metres FROM ({_PLACES}) WHERE {_METRES} <= 2000000")
def geo_within_radius(t):
    near = _places(t).filter(geo.within_radius(c("lat"), c("lon"), 45.0, 9.0, 2_000_000))
    return near.select("c_custkey", F.round(geo.metres(c("lat"), c("lon"), 45.0, 9.0), 2).alias("metres"))


@query(f"SELECT c_custkey FROM ({_PLACES}) ORDER BY round({_METRES}, 4), c_custkey LIMIT 10")
def geo_nearest(t):
    return geo.nearest(_places(t), "lat", "lon", "c_custkey", 45.0, 9.0, 10).select("c_custkey")
