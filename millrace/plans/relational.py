"""Scans, filters, joins, sorting, set operations, subqueries and recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import joins, predicates
from millrace.operators.sets import combined
from millrace.plans.registry import query

c = F.col


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR o_orderpriority = '1-URGENT'")
def filter_and_or(t):
    wanted = predicates.any_of(predicates.all_of(c("o_orderstatus") == "F", c("o_totalprice") > 100000, None), c("o_orderpriority") == "1-URGENT")
    return t.orders.filter(wanted).select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE NOT (c_mktsegment <> 'BUILDING')) AS building FROM customer")
def filter_nothing_given(t):
    kept = t.customer.filter(predicates.all_of()).filter(~predicates.any_of())
    return kept.agg(F.count("*").alias("n"), F.count_if(predicates.negated(c("c_mktsegment") != "BUILDING")).alias("building"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def in_list(t):
    return t.customer.filter(predicates.in_list(c("c_mktsegment"), ["BUILDING", "MACHINERY"]) & predicates.not_in_list(c("c_nationkey"), [1, 2, 3])).select("c_custkey")


@query("SELECT count(*) FILTER (WHERE false) AS in_none, count(*) FILTER (WHERE true) AS not_in_none FROM customer")
def in_list_empty(t):
    return t.customer.agg(F.count_if(predicates.in_list(c("c_nationkey"), [])).alias("in_none"), F.count_if(predicates.not_in_list(c("c_nationkey"), [])).alias("not_in_none"))


@query("SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 10 AND 20 AND p_name LIKE '%a%' AND p_brand ILIKE 'BRAND%' AND p_type NOT LIKE '%TIN'")
def between_like_ilike(t):
    low_high = predicates.between(c("p_size"), 20, 10, symmetric=True)
    return t.part.filter(low_high & c("p_name").like("%a%") & c("p_brand").ilike("BRAND%") & ~c("p_type").like("%TIN")).select("p_partkey", "p_name")


@query("SELECT count(*) FILTER (WHERE k IS NULL) AS nulls, count(*) FILTER (WHERE k IS NOT NULL) AS present, count(*) FILTER (WHERE k IS DISTINCT FROM 3) AS apart FROM (SELECT nullif(c_nationkey, 5) AS k FROM customer)")
def null_tests(t):
    k = F.nullif(c("c_nationkey"), F.lit(5))
    return t.customer.agg(F.count_if(k.isNull()).alias("nulls"), F.count_if(k.isNotNull()).alias("present"), F.count_if(predicates.distinct_from(k, F.lit(3))).alias("apart"))


@query("SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '0[13579]$') AND NOT regexp_matches(c_mktsegment, '(?i)^build')")
def regex_filter(t):
    return t.customer.filter(c("c_name").rlike("0[13579]$") & ~c("c_mktsegment").rlike("(?i)^build")).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity >= 45 AND l_shipdate >= TIMESTAMP '1997-01-01'")
def projection_pushdown(t):
    wanted = (c("l_quantity") >= 45) & (c("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return t.lineitem.filter(wanted).select("l_orderkey", "l_linenumber", (c("l_extendedprice") * (1 - c("l_discount"))).alias("net"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def orderby_limit_offset(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(c("o_totalprice").desc_nulls_first(), c("o_orderkey").asc_nulls_last()).offset(5).limit(20)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def top_k(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(c("l_extendedprice").desc(), "l_orderkey", "l_linenumber").limit(100)


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY k ASC NULLS LAST, o_orderkey) AS ascending, row_number() OVER (PARTITION BY o_custkey ORDER BY k DESC NULLS FIRST, o_orderkey) AS descending FROM (SELECT o_custkey, o_orderkey, nullif(o_orderstatus, 'F') AS k FROM orders)")
def null_ordering(t):
    from pyspark.sql import Window

    rows = t.orders.select("o_custkey", "o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("k"))
    place = lambda order: F.row_number().over(Window.partitionBy("o_custkey").orderBy(order, "o_orderkey")).cast("long")
    return rows.select("o_orderkey", place(c("k").asc_nulls_last()).alias("ascending"), place(c("k").desc_nulls_first()).alias("descending"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def inner_join(t):
    return t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).filter("c_mktsegment = 'BUILDING'").select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'")
def left_join(t):
    return t.customer.join(t.orders, (c("c_custkey") == c("o_custkey")) & (c("o_orderstatus") == "F"), "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM nation RIGHT JOIN supplier ON n_nationkey = s_nationkey AND n_regionkey = 1")
def right_join(t):
    return t.nation.join(t.supplier, (c("n_nationkey") == c("s_nationkey")) & (c("n_regionkey") == 1), "right").select("s_suppkey", "n_name")


@query("SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON c_custkey = s_suppkey")
def full_join(t):
    return t.customer.filter("c_mktsegment = 'BUILDING'").join(t.supplier.filter("s_acctbal > 0"), c("c_custkey") == c("s_suppkey"), "full").select("c_custkey", "s_suppkey")


@query("SELECT a.c_name AS one, b.c_name AS two FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey // 10 AND a.c_nationkey <> b.c_nationkey")
def self_join_alias(t):
    a, b = t.customer.alias("a"), t.customer.alias("b")
    boss = F.expr("b.c_custkey div 10")
    return a.join(b, (c("a.c_custkey") == boss) & (c("a.c_nationkey") != c("b.c_nationkey"))).select(c("a.c_name").alias("one"), c("b.c_name").alias("two"))


@query("SELECT r_regionkey, count(*) AS n FROM region JOIN supplier ON s_acctbal > r_regionkey * 1000 GROUP BY 1")
def theta_join(t):
    return t.region.join(t.supplier, c("s_acctbal") > c("r_regionkey") * 1000).groupBy("r_regionkey").agg(F.count("*").alias("n"))


@query("SELECT r_name, o_orderstatus, count(*) AS n FROM region, (SELECT DISTINCT o_orderstatus FROM orders) GROUP BY 1, 2")
def cross_join_expr(t):
    return t.region.crossJoin(t.orders.select("o_orderstatus").distinct()).groupBy("r_name", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT n_name, r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def star_join(t):
    joined = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) ON c_custkey = o_custkey AND rn = 1")
def any_join(t):
    right = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return joins.any_join(t.customer, right, ["c_custkey"], [c("o_orderdate"), c("o_orderkey")]).select("c_custkey", "o_orderkey")


_PURCHASES = "SELECT event_id AS purchase, user_id, ts FROM events WHERE event_type = 'purchase'"
_VIEWS = "SELECT event_id AS viewed, user_id, ts AS view_ts FROM events WHERE event_type = 'view'"
_ASOF = """SELECT purchase, viewed FROM (SELECT purchase, viewed, row_number() OVER (PARTITION BY purchase ORDER BY view_ts DESC, viewed DESC) AS rn
    FROM ({purchases}) p {how} JOIN ({views}) v ON p.user_id = v.user_id AND v.view_ts <= p.ts) WHERE rn = 1"""


def _asof(t, how):
    purchases = t.events.filter("event_type = 'purchase'").select(c("event_id").alias("purchase"), "user_id", "ts")
    views = t.events.filter("event_type = 'view'").select(c("event_id").alias("viewed"), "user_id", c("ts").alias("view_ts"))
    return joins.asof_join(purchases, views, ["user_id"], "ts", "view_ts", "viewed", how=how).select("purchase", "viewed")


@query(_ASOF.format(purchases=_PURCHASES, views=_VIEWS, how=""))
def asof_join(t):
    return _asof(t, "inner")


@query(_ASOF.format(purchases=_PURCHASES, views=_VIEWS, how="LEFT"))
def asof_join_left(t):
    return _asof(t, "left")


@query("""SELECT e.event_id, w.event_id AS signup FROM events e JOIN (SELECT event_id, user_id, ts, ts + INTERVAL 2 DAY AS until FROM events WHERE event_type = 'signup') w
    ON e.user_id = w.user_id AND e.ts BETWEEN w.ts AND w.until WHERE e.event_type = 'purchase'""")
def interval_join(t):
    signups = t.events.filter("event_type = 'signup'").select(c("event_id").alias("signup"), "user_id", c("ts").alias("begin"), (c("ts") + F.expr("INTERVAL 2 DAY")).alias("until"))
    bought = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return joins.interval_join(bought, signups, ["user_id"], "ts", "begin", "until", 86_400).select("event_id", "signup")


@query("""SELECT e.event_id, w.event_id AS signup FROM events e JOIN (SELECT event_id, user_id, ts, ts + to_seconds(power(20, event_id % 5)::BIGINT * 60) AS until FROM events WHERE event_type = 'signup') w
    ON e.user_id = w.user_id AND e.ts BETWEEN w.ts AND w.until WHERE e.event_type = 'purchase'""")
def interval_join_of_any_length(t):
    """Intervals of a minute to three hundred years, in slots of an hour."""
    until = c("ts") + F.make_dt_interval(secs=(F.pow(F.lit(20), c("event_id") % 5).cast("long") * 60).cast("decimal(18,6)"))
    signups = t.events.filter("event_type = 'signup'").select(c("event_id").alias("signup"), "user_id", c("ts").alias("begin"), until.alias("until"))
    bought = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return joins.interval_join(bought, signups, ["user_id"], "ts", "begin", "until", 3_600).select("event_id", "signup")


_A = "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'"
_B = "SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'"
_C = "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'"


def _operands(t):
    return (
        t.orders.filter("o_orderstatus = 'F'").select(c("o_custkey").alias("k")),
        t.orders.filter("o_orderpriority = '1-URGENT'").select(c("o_custkey").alias("k")),
        t.customer.filter("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("k")),
    )


def _set_operation(name, operation):
    def run(t):
        a, b, _ = _operands(t)
        return combined(a, (operation, b))

    run.__name__ = name
    query(f"({_A}) {operation.upper()} ({_B})")(run)


for _name in ("union", "union all", "intersect", "intersect all", "except", "except all"):
    _set_operation(_name.replace(" ", "_"), _name)


@query(f"({_A}) UNION ALL (({_B}) INTERSECT ({_C}))")
def setop_precedence(t):
    a, b, d = _operands(t)
    return combined(a, ("union all", b), ("intersect", d))


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
def exists(t):
    return joins.exists(t.customer, t.orders.filter("o_totalprice > 200000"), c("c_custkey") == c("o_custkey")).select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
def not_exists(t):
    return joins.not_exists(t.customer, t.orders.filter("o_orderstatus = 'F'"), c("c_custkey") == c("o_custkey")).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def in_sub(t):
    return joins.exists(t.part, t.lineitem.filter("l_quantity >= 49"), c("p_partkey") == c("l_partkey")).select("p_partkey")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier)")
def not_in_sub_null(t):
    return joins.not_in(t.nation, "n_nationkey", t.supplier.select(F.nullif("s_nationkey", F.lit(3)).alias("k")), "k").select("n_nationkey")


@query("SELECT c_custkey FROM (SELECT c_custkey, nullif(c_custkey, 8) AS k FROM customer) WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def not_in_sub(t):
    rows = t.customer.select("c_custkey", F.nullif("c_custkey", F.lit(8)).alias("k"))
    return joins.not_in(rows, "k", t.orders.filter("o_orderstatus = 'F'"), "o_custkey").select("c_custkey")


@query("SELECT c_custkey FROM (SELECT c_custkey, nullif(c_custkey, 8) AS k FROM customer) WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice < 0)")
def not_in_sub_of_nothing(t):
    """Nothing is in an empty set, NULL included."""
    rows = t.customer.select("c_custkey", F.nullif("c_custkey", F.lit(8)).alias("k"))
    return joins.not_in(rows, "k", t.orders.filter("o_totalprice < 0"), "o_custkey").select("c_custkey")


@query("SELECT n_nationkey, n_nationkey IN (SELECT nullif(s_nationkey, 3) FROM supplier WHERE s_suppkey < 30) AS found FROM nation")
def in_sub_projection(t):
    keys = t.supplier.filter("s_suppkey < 30").select(F.nullif("s_nationkey", F.lit(3)).alias("k"))
    facts = keys.agg(F.count_if(c("k").isNull()).alias("nulls"), F.count("*").alias("n"))
    marked = t.nation.join(keys.filter("k is not null").distinct().withColumn("hit", F.lit(True)), c("n_nationkey") == c("k"), "left").crossJoin(F.broadcast(facts))
    return marked.select("n_nationkey", predicates.in_projection(c("n_nationkey"), c("hit").isNotNull(), c("nulls") > 0, c("n") == 0).alias("found"))


@query("SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 4) AS above FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def scalar_sub(t):
    mean = t.customer.agg(F.avg("c_acctbal").alias("mean"))
    return t.customer.crossJoin(F.broadcast(mean)).filter("c_acctbal > mean").select("c_custkey", F.round(c("c_acctbal") - c("mean"), 4).alias("above"))


@query("SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def correlated_scalar_sub(t):
    means = t.orders.groupBy(c("o_custkey").alias("who")).agg((F.avg("o_totalprice") * 1.5).alias("bound"))
    return t.orders.join(means, c("o_custkey") == c("who")).filter("o_totalprice > bound").select("o_orderkey", "o_totalprice")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def eq_any(t):
    return joins.exists(t.supplier, t.nation.filter("n_regionkey = 2"), c("s_nationkey") == c("n_nationkey")).select("s_suppkey")


@query("SELECT p_partkey FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_size < 10)")
def gte_all(t):
    small = t.part.filter("p_size < 10").select(c("p_retailprice").alias("price"))
    return joins.at_least_all(t.part, "p_retailprice", small, "price").select("p_partkey")


@query("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 1000000) SELECT c_name, round(spent, 2) AS spent FROM customer JOIN big ON c_custkey = o_custkey")
def cte(t):
    big = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent")).filter("spent > 1000000")
    return t.customer.join(big, c("c_custkey") == c("o_custkey")).select("c_name", F.round("spent", 2).alias("spent"))


@query("""WITH RECURSIVE chain AS (SELECT c_custkey AS id, c_custkey // 10 AS boss, 0 AS depth FROM customer WHERE c_custkey < 10
    UNION ALL SELECT c.c_custkey, c.c_custkey // 10, chain.depth + 1 FROM customer c JOIN chain ON c.c_custkey // 10 = chain.id AND c.c_custkey >= 10)
    SELECT id, boss, depth FROM chain""")
def recursive_cte(t):
    t.customer.createOrReplaceTempView("mr_customer")
    return t.spark.sql("""WITH RECURSIVE chain(id, boss, depth) AS (SELECT c_custkey, c_custkey div 10, 0 FROM mr_customer WHERE c_custkey < 10
        UNION ALL SELECT c.c_custkey, c.c_custkey div 10, chain.depth + 1 FROM mr_customer c JOIN chain ON c.c_custkey div 10 = chain.id AND c.c_custkey >= 10)
        SELECT id, boss, depth FROM chain""")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
def case_when(t):
    size = F.when(c("o_totalprice") > 300000, "big").when(c("o_totalprice") > 100000, "mid").otherwise("small")
    return t.orders.select("o_orderkey", size.alias("size"), F.when(c("o_orderstatus") == "F", 1).when(c("o_orderstatus") == "O", 2).alias("code"))


@query("SELECT c_custkey, CAST(c_acctbal AS BIGINT) AS whole, coalesce(nullif(c_nationkey, 4), -1) AS nation, TRY_CAST(c_name AS INTEGER) AS bad, CAST(c_custkey AS VARCHAR) AS text FROM (SELECT c_custkey, trunc(c_acctbal) AS c_acctbal, c_nationkey, c_name FROM customer)")
def cast_coalesce(t):
    return t.customer.select("c_custkey", c("c_acctbal").cast("long").alias("whole"), F.coalesce(F.nullif("c_nationkey", F.lit(4)), F.lit(-1)).alias("nation"), c("c_name").try_cast("int").alias("bad"), c("c_custkey").cast("string").alias("text"))


@query("SELECT greatest(k, 10) AS most, least(k, 10) AS least, CASE WHEN k IS NOT NULL THEN greatest(k, 10) END AS most_or_null FROM (SELECT nullif(p_size, 12) AS k FROM part)")
def greatest_least(t):
    from millrace.functions import maths

    k, ten = F.nullif("p_size", F.lit(12)), F.lit(10)
    return t.part.select(maths.greatest(k, ten).alias("most"), maths.least(k, ten).alias("least"), maths.greatest(k, ten, nulls="propagate").alias("most_or_null"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 0 AND c_nationkey = 1")
def default_filters_and_tenant(t):
    from millrace.sources.tables import TENANT, Table

    customer = Table("customer").with_filter("live", lambda: c("c_acctbal") >= 0).scoped_by_tenant("c_nationkey")
    t.spark.conf.set(TENANT, "1")
    try:
        return customer.scan(t.spark, t.folder, ignore=("unknown",)).select("c_custkey", "c_name")
    finally:
        t.spark.conf.unset(TENANT)
