"""Scans in other shapes, bound SQL, JSON tables, money, guards, time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import dates, jsons, money, strings
from millrace.operators import paging
from millrace.plans.registry import query
from millrace.sources import tables

c = F.col


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'O'")
def raw_sql_bound(t):
    t.orders.createOrReplaceTempView("mr_orders")
    return t.spark.sql("SELECT o_orderkey FROM mr_orders WHERE o_totalprice > :least AND o_orderstatus = :status", args={"least": 250000, "status": "O"})


@query("SELECT c_custkey, levenshtein(c_mktsegment, 'BUILDING')::INTEGER AS far FROM customer")
def call_function(t):
    return t.customer.select("c_custkey", F.call_function("levenshtein", c("c_mktsegment"), F.lit("BUILDING")).alias("far"))


@query("SELECT status, max(n) AS most FROM (SELECT o_orderstatus AS status, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2) d GROUP BY 1")
def derived_table(t):
    d = t.orders.groupBy(c("o_orderstatus").alias("status"), "o_custkey").agg(F.count("*").alias("n")).alias("d")
    return d.groupBy("d.status").agg(F.max("d.n").alias("most"))


@query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS number, o_orderkey FROM orders")
def sequence_numbers(t):
    return tables.numbered(t.orders.select("o_orderdate", "o_orderkey"), "number", ["o_orderdate", "o_orderkey"]).select("number", "o_orderkey")


@query("SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS number, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag FROM lineitem")
def sequence_numbers_payload(t):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return tables.numbered(t.lineitem, "number", order).select("number", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag")


@query("SELECT event_id, ts <= now()::TIMESTAMP AS past, true AS same_day FROM events")
def current_time(t):
    """Each of the current functions has one value for a whole statement."""
    same = F.current_date() == F.to_date(F.current_timestamp())
    return t.events.select("event_id", (c("ts") <= F.localtimestamp()).alias("past"), (same & (F.now() == F.current_timestamp())).alias("same_day"))


@query("SELECT count(*) FILTER (WHERE r >= 0 AND r < 1) AS within, count(*) > 0 AS some FROM (SELECT random() AS r FROM orders)")
def random_within(t):
    return t.orders.select(F.rand().alias("r")).agg(F.count_if((c("r") >= 0) & (c("r") < 1)).alias("within"), (F.count("*") > 0).alias("some"))


@query("SELECT p_partkey, p_brand FROM part WHERE lower(p_brand) IN ('brand#2', 'brand#17') AND lower(p_type) < 'medium'")
def collate_nocase(t):
    brand = F.collate("p_brand", "UNICODE_CI")
    return t.part.filter(((brand == F.lit("BRAND#2")) | (brand == F.lit("bRaND#17"))) & (F.collate("p_type", "UTF8_LCASE") < F.lit("Medium"))).select("p_partkey", "p_brand")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 40")
def row_ceiling(t):
    return paging.ceiling(t.orders.select("o_orderkey").orderBy("o_orderkey"), asked=500, budget=40)


@query("SELECT p_partkey, regexp_extract_all(p_name, '([a-z]+) ([a-z])', 1)[1] AS first, regexp_extract_all(p_name, '([a-z]+) ([a-z])', 2)[1] AS second FROM part")
def regexp_match(t):
    found = strings.regexp_match(c("p_name"), "([a-z]+) ([a-z])", 2)
    return t.part.select("p_partkey", F.get(found, 0).alias("first"), F.get(found, 1).alias("second"))


@query("""SELECT p_partkey, regexp_extract_all(p_name, '[aeiou]')[2] AS second, nullif(regexp_extract(substr(p_name, 4), '[a-z]+'), '') AS later,
    length(regexp_extract(p_name, '^[^aeiou]*[aeiou][^aeiou]*[aeiou]')) AS at, CASE WHEN length(regexp_extract(p_name, '^[^ ]* +')) > 0 THEN length(regexp_extract(p_name, '^[^ ]* +')) + 1 ELSE 0 END AS behind FROM part""")
def regexp_occurrences(t):
    name = c("p_name")
    return t.part.select(
        "p_partkey", strings.regexp_substr(name, "[aeiou]", occurrence=2).alias("second"), strings.regexp_substr(name, "[a-z]+", 4).alias("later"),
        strings.regexp_instr(name, "[aeiou]", occurrence=2).cast("long").alias("at"), strings.regexp_instr(name, " +", after=True).cast("long").alias("behind"),
    )


@query()
def sample_fraction(t):
    return t.lineitem.sample(0.1, seed=7).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def membership_guard(t):
    return tables.member(t.customer, "c_custkey", "c_nationkey", 7, "o_custkey")(t.orders).select("o_orderkey")


@query("SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50 OFFSET 10)")
def count_of_limited(t):
    return t.orders.filter("o_orderstatus = 'F'").orderBy("o_orderkey").offset(10).limit(50).agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE p_name || '_' || p_brand LIKE '%#_B%1' ESCAPE '#' AND p_name NOT LIKE '%b%'")
def like_escape(t):
    return t.part.filter(F.expr("p_name || '_' || p_brand LIKE '%#_B%1' ESCAPE '#'") & ~c("p_name").like("%b%")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45 OR p_brand ILIKE '%#1%'")
def not_between(t):
    return t.part.filter(~c("p_size").between(5, 45) | strings.like_nocase(c("p_brand"), "%#1%")).select("p_partkey")


@query("SELECT o_custkey, o_orderkey AS id, o_orderpriority AS name FROM orders UNION ALL SELECT -1, NULL, NULL")
def json_table(t):
    docs = t.orders.groupBy("o_custkey").agg(F.to_json(F.collect_list(F.struct(c("o_orderkey").alias("id"), c("o_orderpriority").alias("name")))).alias("doc"))
    docs = docs.unionByName(t.spark.sql("SELECT -1L AS o_custkey, '[]' AS doc"))
    return jsons.table(docs, "doc", "id long, name string").select("o_custkey", "id", "name")


@query("""SELECT p_partkey, 3::INTEGER AS n, CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 2 END::INTEGER AS deep, CASE WHEN p_partkey % 2 = 0 THEN '["$.name","$.tags[0]"]' ELSE '["$.name"]' END AS at, p_partkey = 4 AS meets, '"' || p_name || '"' AS quoted FROM part""")
def json_inspect(t):
    doc = F.concat(F.lit('{"key":'), c("p_partkey").cast("string"), F.lit(',"name":"x","tags":'), F.when(c("p_partkey") % 2 == 0, F.lit('["x",[1]]')).otherwise(F.lit("[]")), F.lit("}"))
    return t.part.select(
        "p_partkey", jsons.length(doc).alias("n"), jsons.depth(doc).alias("deep"), jsons.search(doc, "x").alias("at"),
        jsons.overlaps(doc, F.lit('{"key":4}')).alias("meets"), jsons.quote(c("p_name")).alias("quoted"),
    )


@query("SELECT o_orderstatus, sum(round(o_totalprice::DECIMAL(28,6) * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY 1")
def money_sum(t):
    return t.orders.groupBy("o_orderstatus").agg(F.sum(money.minor(c("o_totalprice"), "EUR")).alias("cents"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS begin, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(t):
    w = t.events.groupBy(F.window(c("ts").cast("timestamp"), "6 hours"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(c("window.start").cast("timestamp_ntz").alias("begin"), "event_type", "n", "total")


@query("SELECT user_id, min(ts) AS begin, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS visit FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, visit")
def session_windows(t):
    w = t.events.groupBy("user_id", F.session_window(c("ts").cast("timestamp"), "12 hours")).agg(F.count("*").alias("n"))
    return w.select("user_id", c("session_window.start").cast("timestamp_ntz").alias("begin"), "n")


@query("SELECT o_orderkey, o_orderdate + INTERVAL 1 YEAR AS next_year, (o_orderdate + INTERVAL 2 WEEK)::DATE AS fortnight, last_day(o_orderdate) AS month_end, make_date(year(o_orderdate), 12, 31) AS year_end FROM orders")
def date_intervals(t):
    d = c("o_orderdate")
    return t.orders.select("o_orderkey", dates.modified(d, "+1 year").alias("next_year"), dates.modified(d, "+2 weeks").cast("date").alias("fortnight"), F.last_day(d).alias("month_end"), F.make_date(F.year(d), F.lit(12), F.lit(31)).alias("year_end"))


@query("SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%' AND c_acctbal > 5000")
def belongs_to(t):
    near = t.nation.join(t.region.filter(c("r_name").like("A%")), c("n_regionkey") == c("r_regionkey"))
    return t.customer.filter("c_acctbal > 5000").join(near, c("c_nationkey") == c("n_nationkey")).select("c_custkey", "r_name")
