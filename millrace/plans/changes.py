"""Change data, event logs, dependent views, time partitions, each derived from ``events``."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.streaming import changes as ch
from millrace.streaming import logs

c = F.col
_OP = "CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END"
_CHANGES = f"SELECT {_OP} AS op, user_id::VARCHAR AS key, value, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events"


def _changes(t):
    op = F.when(c("event_type") == "error", "delete").when(c("event_type") == "signup", "insert").otherwise("update")
    return t.events.select(op.alias("op"), c("user_id").cast("string").alias("key"), "value", c("event_id").alias("seq"), ch.live_version(c("event_id")).alias("version"), c("ts").alias("at"))


@query(f"SELECT key, op, value FROM ({_CHANGES}) WHERE rn = 1 AND op <> 'delete'")
def mirror_latest(t):
    return ch.latest(ch.normalized(_changes(t)), ["key"]).select("key", "op", "value")


@query(f"SELECT count(*) AS deleted FROM ({_CHANGES}) WHERE rn = 1 AND op = 'delete'")
def mirror_deleted(t):
    return ch.latest(_changes(t), ["key"], deleted=c("op") != "delete").agg(F.count("*").alias("deleted"))


@query("SELECT count(*) FILTER (WHERE event_id % 2 = 0) AS live, count(*) FILTER (WHERE event_id % 2 = 1) AS clock FROM events")
def change_versions(t):
    rows = _changes(t).withColumn("version", F.when(c("seq") % 2 == 0, c("version")))
    stamped = ch.normalized(rows)
    live = F.lit(str(ch.LIVE)).cast(ch.VERSION)
    return stamped.agg(F.count_if(c("version") >= live).alias("live"), F.count_if((c("version") < live) & (c("version") >= F.lit(str(ch.CLOCK)).cast(ch.VERSION))).alias("clock"))


def _mirror(t):
    """The orders with some rows lost, some changed and some made up."""
    own = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus").filter("o_orderkey % 997 <> 5")
    changed = own.withColumn("o_totalprice", F.when(c("o_orderkey") % 1009 == 7, c("o_totalprice") + 1).otherwise(c("o_totalprice")))
    return changed.unionByName(t.orders.filter("o_orderkey % 1499 = 3").select((-c("o_orderkey")).alias("o_orderkey"), "o_totalprice", "o_orderstatus"))


@query("""SELECT key, kind FROM (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 997 = 5 THEN 'missing' WHEN o_orderkey % 1009 = 7 THEN 'mismatch' END AS kind FROM orders
    UNION ALL SELECT -o_orderkey, 'extra' FROM orders WHERE o_orderkey % 1499 = 3) WHERE kind IS NOT NULL""")
def mirror_verify_digest(t):
    columns, source = ["o_totalprice", "o_orderstatus"], t.orders
    mirror = _mirror(t)
    ranges = ch.verify_ranges(source, mirror, "o_orderkey", ["o_orderkey", *columns], 1000)
    return ch.divergences(source, mirror, "o_orderkey", columns, ranges, 1000)


@query("SELECT o_orderkey AS key, 'mismatch' AS kind FROM orders WHERE o_orderpriority = '1-URGENT'")
def mirror_verify_least_difference(t):
    """One unit in the last place of a double tells rows apart."""
    columns = ["o_totalprice", "o_orderstatus"]
    moved = t.orders.withColumn("o_totalprice", F.when(c("o_orderpriority") == "1-URGENT", c("o_totalprice") * (1 + 3e-16)).otherwise(c("o_totalprice")))
    ranges = ch.verify_ranges(t.orders, moved, "o_orderkey", ["o_orderkey", *columns], 1000)
    return ch.divergences(t.orders, moved, "o_orderkey", columns, ranges, 1000)


@query("SELECT o_orderkey // 500 AS range, 2 * count(*) AS source_rows, 2 * count(*) AS mirror_rows FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'P') > 0")
def mirror_verify_copies(t):
    """Rows in two copies each: two copies of another row in their place are seen."""
    twice = t.orders.unionByName(t.orders)
    other = twice.withColumn("o_totalprice", F.when(c("o_orderstatus") == "P", c("o_totalprice") + 1).otherwise(c("o_totalprice")))
    return ch.verify_ranges(twice, other, "o_orderkey", ["o_orderkey", "o_totalprice"], 500)


@query(f"""SELECT substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21) AS point_id, CASE WHEN op = 'delete' THEN 'delete' ELSE 'upsert' END AS op,
    CASE WHEN op <> 'delete' THEN to_json([value / 2, -value]) END AS vector, CASE WHEN op <> 'delete' THEN '{{"key":"' || key || '","seq":' || seq || '}}' END AS payload
    FROM (SELECT *, md5('["' || key || '"]') AS m FROM ({_CHANGES}) WHERE rn = 1)""")
def mirror_vector_points(t):
    embed = lambda rows: rows.withColumn("vector", F.array(c("value") / 2, -c("value")))
    points = ch.vector_changes(ch.normalized(_changes(t)), ["key"], embed, ["key", "seq"])
    return points.select("point_id", "op", F.to_json("vector").alias("vector"), "payload")


@query("SELECT user_id::VARCHAR AS aggregate_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS version, event_type, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS balance FROM events")
def event_replay(t):
    log = _log(t)
    from pyspark.sql import Window

    return logs.replay(log).select("aggregate_id", "version", "event_type", F.round(F.sum("value").over(Window.partitionBy("aggregate_id").orderBy("version")), 6).alias("balance"))


def _log(t):
    """The events appended to an empty store."""
    rows = t.events.select(F.lit("user").alias("aggregate_type"), c("user_id").cast("string").alias("aggregate_id"), c("event_id").alias("seq"), "event_type", "value")
    empty = rows.limit(0).withColumn("version", F.lit(0).cast("long"))
    accepted, _ = logs.appended(empty, rows, rows.select(*logs.STREAM).distinct().withColumn("expected", F.lit(-1)))
    return accepted


@query("SELECT user_id::VARCHAR AS aggregate_id, (count(*) - 1)::BIGINT AS now FROM events GROUP BY user_id HAVING user_id % 2 = 0")
def event_append_conflicts(t):
    log = _log(t)
    fresh = log.select(*logs.STREAM, "seq", "event_type", "value")
    stale = log.select(*logs.STREAM).distinct().filter("cast(aggregate_id as bigint) % 2 = 0").withColumn("expected", F.lit(-1))
    _, conflicts = logs.appended(log, fresh, stale)
    return conflicts.select("aggregate_id", c("now").cast("long").alias("now"))


@query("SELECT count(*) AS later FROM (SELECT row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS version FROM events) WHERE version > 4")
def event_since_snapshot(t):
    log = _log(t)
    return logs.since_snapshot(log, log.filter("version in (2, 4)")).agg(F.count_if(c("version") > 4).alias("later"))


@query("SELECT event_id AS id FROM events e WHERE event_type <> 'signup' AND ts <= TIMESTAMP '2024-01-15' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = e.user_id AND b.event_type <> 'signup' AND b.ts > TIMESTAMP '2024-01-15' AND b.event_id < e.event_id) ORDER BY event_id LIMIT 500")
def outbox_due(t):
    outbox = t.events.select(
        c("event_id").alias("id"), c("user_id").alias("aggregate_id"), c("ts").alias("available_at"), F.when(c("event_type") == "signup", c("ts")).alias("published_at"), F.lit(None).cast("timestamp_ntz").alias("failed_at"), F.lit(0).alias("attempts"),
    )
    return logs.due(outbox, datetime.datetime(2024, 1, 15), 500).select("id")


@query("""SELECT day, users, round(revenue / users, 6) AS per_user FROM (SELECT date_trunc('day', ts) AS day, count(DISTINCT user_id) AS users, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS revenue FROM events GROUP BY 1)""")
def matview_dag(t):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    views = (
        logs.Views()
        .define("report", ("users", "revenue"), lambda u, r: u.join(r, "day").select("day", "users", F.round(c("revenue") / c("users"), 6).alias("per_user")))
        .define("users", ("events",), lambda e: e.groupBy(day).agg(F.count_distinct("user_id").alias("users")))
        .define("revenue", ("events",), lambda e: e.groupBy(day).agg(F.sum(F.when(c("event_type") == "purchase", c("value")).otherwise(0.0)).alias("revenue")))
    )
    return views.refresh({"events": t.events})["report"]


@query("SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS partition_start, count(*) AS n FROM events GROUP BY 1")
def time_partitions(t):
    return logs.partitioned(t.events, "ts", 7 * 86_400).groupBy("partition_start").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS partition_start FROM events WHERE ts < TIMESTAMP '2024-01-11'")
def time_partitions_expired(t):
    return logs.expired(t.events, "ts", datetime.datetime(2024, 1, 21), 86_400, 10 * 86_400)


@query("SELECT o_orderkey AS key, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'X' FROM orders WHERE o_orderkey % 2 = 1")
def backfill_loses_to_live(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    seeds = ch.backfill(rows, "o_orderkey", F.lit("2024-01-01").cast("timestamp_ntz"))
    live = rows.filter("o_orderkey % 2 = 1").select("o_orderkey", F.lit("X").alias("o_orderstatus"), c("o_orderkey").cast("string").alias("key"), F.lit("update").alias("op"), F.lit("2023-01-01").cast("timestamp_ntz").alias("at"), ch.live_version(F.lit(1)).alias("version"))
    return ch.latest(seeds.unionByName(live), ["key"]).select(c("o_orderkey").alias("key"), "o_orderstatus")


@query("SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal, NULL::VARCHAR AS note FROM supplier")
def schema_widen(t):
    from pyspark.sql.types import StringType, StructField, StructType

    live = t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    widened = [StructField(f.name, live.schema["s_suppkey"].dataType if f.name == "s_nationkey" else f.dataType) for f in live.schema.fields]
    wanted = StructType([*widened, StructField("note", StringType())])
    return ch.evolved(live, ch.plan_evolution(live.schema, wanted), wanted)
