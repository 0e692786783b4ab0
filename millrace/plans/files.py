"""Files and streams: tables from several folders, partitioned and bucketed writes, change pumps, typed cursors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import paging, vectors
from millrace.plans.registry import query
from millrace.session import scoped, shared_folder
from millrace.sources import tables
from millrace.streaming import changes as ch

c = F.col


def _place(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderstatus, 2 * count(*) AS n, 2 * count(DISTINCT o_orderkey) AS twice FROM orders GROUP BY 1")
def shards_of_one_table(t):
    both = tables.shards(t.spark, [t.folder, t.folder], tables.Table("orders"))
    return both.groupBy("o_orderstatus").agg(F.count("*").alias("n"), (2 * F.count_distinct("o_orderkey")).alias("twice"))


@query("SELECT c_custkey FROM customer")
def unscoped_scan(t):
    """All default filters lifted; one that is lifted by name leaves the other."""
    own = tables.Table("customer").with_filter("rich", lambda: c("c_acctbal") > 5000).with_filter("west", lambda: c("c_nationkey") < 5)
    return own.scan(t.spark, t.folder, ignore=None).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey < 5")
def filter_lifted_by_name(t):
    own = tables.Table("customer").with_filter("rich", lambda: c("c_acctbal") > 5000).with_filter("west", lambda: c("c_nationkey") < 5)
    return own.scan(t.spark, t.folder, ignore=("rich",)).select("c_custkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2")
def partitioned_write(t):
    """Rows written by partition and in order, read back by one partition."""
    place = _place(t, "lineitem")
    tables.write(t.lineitem, place, partition_by=("l_returnflag",), sort_by=("l_shipdate",))
    back = t.spark.read.schema(t.lineitem.schema).parquet(place)
    return back.filter("l_returnflag = 'R'").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT key, op, value FROM (SELECT CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS op, user_id::VARCHAR AS key, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND op <> 'delete'")
def change_pump(t):
    """Changes streamed in batches into a log, and the log's latest rows."""
    place = _place(t, "pump")
    op = F.when(c("event_type") == "error", "delete").when(c("event_type") == "signup", "insert").otherwise("update")
    rows = t.events.select(op.alias("op"), c("user_id").cast("string").alias("key"), "value", ch.live_version(c("event_id")).alias("version"), c("ts").alias("at"))
    rows.repartition(4).write.parquet(f"{place}/in")
    ch.pump(ch.stream(t.spark, f"{place}/in", rows.schema, 2), [ch.append_sink(f"{place}/log")], f"{place}/progress").awaitTermination()
    log = t.spark.read.schema(rows.schema).option("basePath", f"{place}/log").parquet(f"{place}/log")
    return ch.latest(log.select("op", "key", "value", "version"), ["key"]).select("key", "op", "value")


@query("SELECT event_id, strftime(make_timestamp(event_id * 3600000000) + INTERVAL 2 HOUR, '%Y-%m-%d %H') AS hour FROM events")
def settings_scoped(t):
    """A time zone that holds while a plan is made and kept, and no longer."""
    before = t.spark.conf.get("spark.sql.session.timeZone")
    with scoped(t.spark, {"spark.sql.session.timeZone": "Etc/GMT-2"}):
        place = _place(t, "hours")
        at = F.timestamp_seconds(c("event_id") * 3600)
        t.events.select("event_id", F.date_format(at, "yyyy-MM-dd HH").alias("hour")).write.parquet(place)
    assert t.spark.conf.get("spark.sql.session.timeZone") == before
    return t.spark.read.schema("event_id long, hour string").parquet(place)


@query("SELECT event_id FROM events WHERE event_id > 70 ORDER BY ts, event_id LIMIT 26")
def keyset_typed_cursor(t):
    """A cursor of a time, a decimal and a number goes out as text and comes back."""
    keys = [paging.Key("ts"), paging.Key("amount"), paging.Key("event_id")]
    rows = t.events.select("ts", c("value").cast("decimal(18,4)").alias("amount"), "event_id")
    at = rows.filter("event_id = 70").first()
    if at is None:
        return rows.select("event_id").limit(0)
    return paging.page_frame(rows, keys, 25, paging.encode(keys, [at.ts, at.amount, at.event_id])).select("event_id")


@query("SELECT vec_id, len(embedding) AS n, true AS same FROM embeddings")
def vector_text_codec(t):
    """Vectors as text and back, to the text's six digits."""
    text = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), F.lit("]"))
    back = vectors.from_text(text)
    near = F.forall(F.arrays_zip(c("embedding").alias("a"), back.alias("b")), lambda p: F.abs(p["a"] - p["b"]) <= 1e-6)
    return t.embeddings.select("vec_id", F.size(back).cast("long").alias("n"), near.alias("same"))
