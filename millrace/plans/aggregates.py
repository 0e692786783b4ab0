"""Grouping and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import aggregates as a
from millrace.operators.joins import first_per_key
from millrace.plans.registry import query

c = F.col


@query("SELECT date_trunc('day', ts) AS day, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS hits FROM events GROUP BY 1")
def agg_event_daily_quantile(t):
    rows = t.events.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "value")
    ranked = a.quantiles(rows, ["day"], "value", {"p95": 0.95})
    # Hits count NULL values too.
    hits = rows.groupBy("day").agg(F.count("*").alias("hits"))
    return hits.join(ranked, "day", "left").select("day", F.round("p95", 6).alias("p95"), "hits")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net,
    round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(t):
    net = c("l_extendedprice") * (1 - c("l_discount"))
    rows = t.lineitem.filter(c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(net), 2).alias("sum_net"),
        F.round(F.sum(net * (1 + c("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most, min(o_totalprice) AS least FROM orders GROUP BY 1 HAVING count(*) > 12")
def group_having(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"), F.min("o_totalprice").alias("least")).filter("n > 12")


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(nullif(l_linenumber, 1)) AS numbered FROM lineitem GROUP BY 1")
def count_distinct(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count(F.nullif("l_linenumber", F.lit(1))).alias("numbered"))


@query("SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, sum(user_id) FILTER (WHERE value > 1e12) AS none_match, max(value) FILTER (WHERE value < 50) AS best_low FROM events GROUP BY 1")
def filter_agg(t):
    v = c("value")
    return t.events.groupBy("event_type").agg(
        a.filtered(F.count, F.lit(1), v > 50).alias("high"), a.filtered(F.sum, c("user_id"), v > 1e12).alias("none_match"), a.filtered(F.max, v, v < 50).alias("best_low")
    )


@query("SELECT o_orderstatus, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS big, sum(CASE WHEN o_orderpriority = 'none' THEN o_custkey END)::BIGINT AS none_match, sum(CASE WHEN o_totalprice > 100000 THEN o_custkey END)::BIGINT AS some FROM orders GROUP BY 1")
def count_if_sum_if(t):
    big = c("o_totalprice") > 100000
    return t.orders.groupBy("o_orderstatus").agg(F.count_if(big).alias("big"), a.sum_if(c("o_orderpriority") == "none", c("o_custkey")).alias("none_match"), a.sum_if(big, c("o_custkey")).alias("some"))


@query("SELECT p_brand, sum(DISTINCT p_size)::BIGINT AS sizes, round(avg(DISTINCT p_size), 6) AS mean_size FROM part GROUP BY 1")
def sum_avg_distinct(t):
    return t.part.groupBy("p_brand").agg(F.sum_distinct("p_size").alias("sizes"), F.round(F.expr("avg(DISTINCT p_size)"), 6).alias("mean_size"))


@query("SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY o_orderpriority) AS names, string_agg(nullif(o_orderpriority, o_orderpriority), ',') AS nothing FROM orders GROUP BY 1")
def string_agg_ordered(t):
    return t.orders.groupBy("o_custkey").agg(a.group_concat(c("o_orderpriority"), c("o_orderpriority"), "|").alias("names"), a.group_concat(F.nullif("o_orderpriority", c("o_orderpriority")), c("o_orderpriority")).alias("nothing"))


@query("SELECT o_orderpriority, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1")
def group_concat_distinct(t):
    return t.orders.groupBy("o_orderpriority").agg(F.array_join(a.uniq_array(c("o_orderstatus")), ",").alias("statuses"))


@query("SELECT o_custkey, to_json(list(nullif(o_orderkey, 3) ORDER BY o_orderkey)) AS every, to_json(list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderkey <> 3)) AS present FROM orders GROUP BY 1")
def array_agg_nulls(t):
    k = F.nullif("o_orderkey", F.lit(3))
    every = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", k.alias("v")))), lambda x: x["v"])
    return t.orders.groupBy("o_custkey").agg(F.to_json(every, {"ignoreNullFields": "false"}).alias("every"), F.to_json(F.sort_array(a.array_agg(k, keep_nulls=False))).alias("present"))


@query("SELECT c_nationkey, to_json(list(DISTINCT c_mktsegment ORDER BY c_mktsegment)) AS segments FROM customer GROUP BY 1")
def group_uniq_array(t):
    return t.customer.groupBy("c_nationkey").agg(F.to_json(a.uniq_array(c("c_mktsegment"))).alias("segments"))


@query("""SELECT o_custkey, arg_max(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey)) AS dearest, arg_min(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey)) AS cheapest FROM orders GROUP BY 1""")
def argmax_argmin(t):
    key, price = c("o_orderkey"), c("o_totalprice")
    return t.orders.groupBy("o_custkey").agg(a.arg_max(key, price, key).alias("dearest"), a.arg_min(key, price, key).alias("cheapest"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.9), 9) AS p90 FROM events GROUP BY 1")
def quantile_exact(t):
    ranked = a.quantiles(t.events, ["event_type"], "value", {"median": 0.5, "p90": 0.9})
    return ranked.select("event_type", F.round("median", 9).alias("median"), F.round("p90", 9).alias("p90"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def quantile_disc(t):
    return a.quantiles(t.events, ["event_type"], "value", {"median": 0.5, "p99": 0.99}, discrete=True).drop("n")


@query("SELECT o_custkey, round(quantile_cont(o_totalprice, 0.25), 6) AS low, quantile_disc(o_totalprice, 0.5) AS mid, count(o_totalprice) AS n FROM (SELECT o_custkey, nullif(o_totalprice, 0) AS o_totalprice FROM orders) GROUP BY 1")
def quantiles_of_many_groups(t):
    low = a.quantiles(t.orders, ["o_custkey"], "o_totalprice", {"low": 0.25})
    return low.join(a.quantiles(t.orders, ["o_custkey"], "o_totalprice", {"mid": 0.5}, discrete=True).drop("n"), "o_custkey").select("o_custkey", F.round("low", 6).alias("low"), "mid", "n")


@query("""SELECT l_returnflag, quantile_disc(CASE WHEN ms < 1024 THEN ms ELSE ms // 16 * 16 END, 0.9)::BIGINT AS p90 FROM
    (SELECT l_returnflag, least(greatest(floor(l_extendedprice / 2), 0), 30000)::BIGINT AS ms FROM lineitem) GROUP BY 1""")
def quantile_timing(t):
    return a.quantile_timing(t.lineitem.select("l_returnflag", (c("l_extendedprice") / 2).alias("ms")), ["l_returnflag"], "ms", 0.9, "p90")


@query()
def quantile_approximate(t):
    return t.events.groupBy("event_type").agg(F.percentile_approx("value", [0.5, 0.9, 0.99], 10_000).alias("quantiles"))


@query("SELECT p_brand, bool_and(p_size > 1) AS every, bool_or(p_size > 49) AS some FROM part GROUP BY 1")
def bool_and_or(t):
    return t.part.groupBy("p_brand").agg(F.bool_and(c("p_size") > 1).alias("every"), F.bool_or(c("p_size") > 49).alias("some"))


@query("SELECT coalesce(sum(CASE WHEN p_size > 1000 THEN p_retailprice END), 0.0) AS nothing, round(coalesce(sum(p_retailprice), 0.0), 2) AS everything FROM part")
def total(t):
    return t.part.agg(a.total(F.when(c("p_size") > 1000, c("p_retailprice"))).alias("nothing"), F.round(a.total(c("p_retailprice")), 2).alias("everything"))


@query("SELECT o_custkey, to_json(list(o_orderpriority ORDER BY o_orderkey)) AS names FROM orders GROUP BY 1")
def json_agg(t):
    return t.orders.groupBy("o_custkey").agg(a.json_array(c("o_orderpriority"), c("o_orderkey")).alias("names"))


@query("SELECT o_custkey, '{' || string_agg('\"' || 'k' || o_orderkey || '\":' || o_orderkey, ',' ORDER BY 'k' || o_orderkey) || '}' AS named FROM orders GROUP BY 1")
def json_object_agg(t):
    return t.orders.groupBy("o_custkey").agg(a.json_object(F.concat(F.lit("k"), c("o_orderkey").cast("string")), c("o_orderkey")).alias("named"))


@query()
def approx_distinct(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("uniq"), a.uniq_hll(c("l_partkey")).alias("hll12"))


@query("SELECT o_orderpriority, mode(o_orderstatus ORDER BY o_orderstatus) AS heavy FROM (SELECT o_orderpriority, o_orderstatus, count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS n FROM orders) GROUP BY 1")
def any_heavy(t):
    return t.orders.groupBy("o_orderpriority").agg(a.any_heavy(c("o_orderstatus")).alias("heavy"))


@query()
def any_and_last(t):
    return t.orders.groupBy("o_orderpriority").agg(F.any_value("o_custkey").alias("some"), F.last("o_custkey").alias("last"))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def distinct_on(t):
    return first_per_key(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [c("o_orderdate").desc(), c("o_orderkey").desc()])


@query("SELECT sum(v)::BIGINT AS total, count(v) AS n, max(v) AS most FROM (SELECT c_custkey AS v FROM customer WHERE c_custkey < 0)")
def aggregate_of_nothing(t):
    return t.customer.filter("c_custkey < 0").agg(F.sum("c_custkey").alias("total"), F.count("c_custkey").alias("n"), F.max("c_custkey").alias("most"))
