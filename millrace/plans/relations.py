"""Relations between tables, nested loads and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import paging
from millrace.operators import relations as r
from millrace.plans.registry import query

c = F.col


def _orders_of(t, where=None):
    return r.HasMany(t.orders if where is None else t.orders.filter(where), "c_custkey", "o_custkey")


def _suppliers_of(t):
    return r.ManyToMany(t.lineitem, "p_partkey", "l_partkey", "l_suppkey", t.supplier, "s_suppkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def where_has(t):
    return r.where_has(t.customer, _orders_of(t, "o_orderpriority = '1-URGENT'")).select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def where_doesnt_have(t):
    return r.where_doesnt_have(t.customer, _orders_of(t)).select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def where_doesnt_have_such(t):
    return r.where_doesnt_have(t.customer, _orders_of(t, "o_orderpriority = '1-URGENT'")).select("c_custkey")


@query("SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey >= 10 THEN c_custkey // 10 END AS boss FROM customer) e WHERE NOT EXISTS (SELECT 1 FROM (SELECT CASE WHEN c_custkey >= 10 THEN c_custkey // 10 END AS boss FROM customer) m WHERE m.boss = e.c_custkey)")
def where_doesnt_have_self(t):
    people = t.customer.withColumn("boss", F.when(c("c_custkey") >= 10, F.expr("c_custkey div 10")))
    return r.where_doesnt_have(people, r.HasMany(people.select(c("boss").alias("led_by")), "c_custkey", "led_by")).select("c_custkey")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1 HAVING count(o_orderkey) >= 12")
def has_count_gte(t):
    return r.with_count(t.customer, _orders_of(t), "n").filter("n >= 12").select("c_custkey", "n")


@query("SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1 HAVING count(o_orderkey) < 5")
def has_count_lt(t):
    return r.with_count(t.customer, _orders_of(t), "n").filter("n < 5").select("c_custkey")


@query("""SELECT n_name, CASE WHEN count(s_suppkey) = 0 THEN '[]' ELSE to_json(list(struct_pack(s_suppkey := s_suppkey, s_name := s_name) ORDER BY s_suppkey) FILTER (WHERE s_suppkey IS NOT NULL)) END AS suppliers
    FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON n_nationkey = s_nationkey GROUP BY n_nationkey, n_name""")
def nested_load_json(t):
    relation = r.HasMany(t.supplier.filter("s_acctbal > 5000"), "n_nationkey", "s_nationkey")
    return r.load(t.nation, relation, "suppliers", ["s_suppkey", "s_name"], "s_suppkey").select("n_name", F.to_json("suppliers").alias("suppliers"))


@query("SELECT c_custkey, to_json(list(o_orderkey ORDER BY o_orderkey)) AS first_three FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 3 GROUP BY 1")
def nested_load_limited(t):
    loaded = r.load(t.customer, _orders_of(t), "orders", ["o_orderkey"], "o_orderkey", limit=3).filter(F.size("orders") > 0)
    return loaded.select("c_custkey", F.to_json(F.transform("orders", lambda o: o["o_orderkey"])).alias("first_three"))


@query("SELECT c_custkey, min(o_orderkey) AS first FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def load_one(t):
    return r.load_one(t.customer, _orders_of(t), "o", ["o_orderkey"], "o_orderkey").select("c_custkey", c("o.o_orderkey").alias("first"))


@query("SELECT p_partkey, count(DISTINCT l_suppkey) AS suppliers FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1")
def m2m_count(t):
    return r.with_count(t.part, _suppliers_of(t), "suppliers").select("p_partkey", "suppliers")


@query("SELECT p_partkey, to_json(list(DISTINCT l_suppkey ORDER BY l_suppkey)) AS suppliers FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size = 7 GROUP BY 1")
def m2m_load(t):
    loaded = r.load(t.part.filter("p_size = 7"), _suppliers_of(t), "s", ["s_suppkey"], "s_suppkey").filter(F.size("s") > 0)
    return loaded.select("p_partkey", F.to_json(F.transform("s", lambda x: x["s_suppkey"])).alias("suppliers"))


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' THEN '{"n_name":"' || n_name || '"}' WHEN event_type = 'view' THEN '{"r_name":"' || r_name || '"}' END AS target
    FROM events LEFT JOIN nation ON event_type = 'purchase' AND n_nationkey = user_id % 30 LEFT JOIN region ON event_type = 'view' AND r_regionkey = user_id % 30""")
def morph_load(t):
    rows = t.events.select("event_id", "event_type", (c("user_id") % 30).cast("int").alias("target_id"))
    nations = t.nation.select("n_nationkey", "n_name")
    targets = {"purchase": (nations, "n_nationkey"), "view": (t.region.select("r_regionkey", "r_name"), "r_regionkey")}
    loaded = r.load_morph(rows, "event_type", "target_id", targets, "json")
    name = F.coalesce(F.get_json_object("json", "$.n_name"), F.get_json_object("json", "$.r_name"))
    return loaded.select("event_id", F.when(name.isNotNull(), F.concat(F.when(c("event_type") == "purchase", '{"n_name":"').otherwise('{"r_name":"'), name, F.lit('"}'))).alias("target"))


_KEYS = [paging.Key("o_orderdate", descending=True), paging.Key("o_orderkey")]


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 26 OFFSET 50")
def keyset_page_3(t):
    rows, cursor = t.orders.select("o_orderkey", "o_orderdate"), None
    for _ in range(2):
        cursor = paging.page(rows, _KEYS, 25, cursor).next_cursor
    return paging.page_frame(rows, _KEYS, 25, cursor).select("o_orderkey")


@query("SELECT c_custkey, k FROM (SELECT c_custkey, nullif(c_nationkey, 5) AS k FROM customer) ORDER BY k ASC NULLS LAST, c_custkey LIMIT 1000 OFFSET 60")
def keyset_nulls(t):
    rows = t.customer.select("c_custkey", F.nullif("c_nationkey", F.lit(5)).alias("k"))
    keys = [paging.Key("k"), paging.Key("c_custkey")]
    last = paging.page(rows, keys, 60).next_cursor
    return paging.page_frame(rows, keys, 999, last)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 100) ORDER BY o_orderkey DESC LIMIT 11")
def keyset_before(t):
    keys = [paging.Key("o_orderkey")]
    at = t.orders.select("o_orderkey").orderBy("o_orderkey").offset(100).limit(1).first()
    if at is None:  # too few rows for a place to stand at: nothing is before it
        return t.orders.select("o_orderkey").limit(0)
    return paging.page_frame(t.orders.select("o_orderkey"), keys, 10, paging.encode(keys, [at[0]]), forward=False)
