"""Streams against batch, failing sinks, evolution plans, outbox rounds, view order."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.streaming import changes, logs

SCHEMA = "op string, key string, value long, version long, at timestamp_ntz"
AT = datetime.datetime(2024, 1, 1)
ROWS = [("insert", "a", 1, 5, AT), ("update", "a", 2, 7, AT), ("update", "a", 3, 6, AT), ("insert", "b", 4, 1, AT), ("delete", "b", None, 2, AT), ("insert", "c", 9, None, AT)]


def test_stream_equals_batch_and_bears_a_failing_sink(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for i in range(3):
        df.filter(F.pmod(F.hash("value"), F.lit(3)) == i).write.parquet(f"{tmp_path}/in", mode="append")
    failed = []

    def flaky(batch, number):
        if number == 0 and not failed:
            failed.append(number)
            raise RuntimeError("sink is away")

    def run():
        stream = changes.stream(spark, f"{tmp_path}/in", df.schema, files_per_batch=1)
        changes.pump(stream, [changes.append_sink(f"{tmp_path}/out"), flaky], f"{tmp_path}/checkpoint").awaitTermination()

    with pytest.raises(Exception, match="sink is away"):
        run()
    run()
    mirror = changes.latest(spark.read.parquet(f"{tmp_path}/out"), ["key"])
    batch = changes.latest(changes.normalized(df), ["key"])
    assert sorted((r.key, r.value) for r in mirror.collect()) == sorted((r.key, r.value) for r in batch.collect()) == [("a", 2), ("c", 9)]


def test_unknown_changes_are_errors(spark):
    for bad in (("merge", "a", 1, 1, AT), ("insert", None, 1, 1, AT)):
        with pytest.raises(Exception, match="not a change"):
            changes.normalized(spark.createDataFrame([bad], SCHEMA)).collect()


def test_watermarked_windows_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(4).write.parquet(f"{tmp_path}/events")
    stream = changes.stream(spark, f"{tmp_path}/events", events.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = stream.withWatermark("ts", "60 days").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    counts.writeStream.format("memory").queryName("mr_counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    batch = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(str, spark.table("mr_counts").collect())) == sorted(map(str, batch.collect()))


def test_evolution(spark):
    live = StructType.fromDDL("id int not null, n string, old double, x float")
    wanted = StructType([StructField("id", LongType(), True), StructField("n", StringType()), StructField("new", StringType()), StructField("x", LongType())])
    steps = changes.plan_evolution(live, wanted)
    assert {(s.action, s.column) for s in steps} == {("widen", "id"), ("add", "new"), ("refuse", "x"), ("refuse", "old")}
    with pytest.raises(ValueError, match="refused: x"):
        changes.evolved(spark.createDataFrame([], live), steps, wanted)
    assert ("drop", "old") in {(s.action, s.column) for s in changes.plan_evolution(live, wanted, allow_drop=("old",))}
    mirror = changes.mirror_schema(StructType.fromDDL("id bigint, tags array<string>, b boolean, raw binary"), "id")
    assert [f.dataType.simpleString() for f in mirror] == ["bigint", "string", "boolean", "string", "decimal(20,0)", "tinyint"]
    with pytest.raises(ValueError):
        changes.mirror_schema(live, "absent")


def test_digests_tell_null_from_empty_and_ignore_float_width(spark):
    one = spark.createDataFrame([("", 1.5), (None, 1.5)], "s string, x double")
    both = [r.d for r in one.select(changes.digest(one, ["s", "x"]).alias("d")).collect()]
    narrow = one.withColumn("x", F.col("x").cast("float"))
    assert both[0] != both[1] and [r.d for r in narrow.select(changes.digest(narrow, ["s", "x"]).alias("d")).collect()] == both


def test_outbox_rounds(spark):
    now = datetime.datetime(2024, 1, 1, 12)
    rows = [(1, "a", now, None, None, 0, None), (2, "a", now, None, None, 9, None), (3, None, now, None, None, 0, None), (4, "b", now + datetime.timedelta(hours=1), None, None, 1, "x"), (5, "b", now, None, None, 0, None)]
    outbox = spark.createDataFrame(rows, "id long, aggregate_id string, available_at timestamp_ntz, published_at timestamp_ntz, failed_at timestamp_ntz, attempts int, last_error string")
    assert [r.id for r in logs.due(outbox, now, 10).collect()] == [1, 2, 3]
    outcomes = spark.createDataFrame([(1, True, None), (2, False, "gone"), (3, False, "slow")], "id long, ok boolean, error string")
    after = {r.id: r for r in logs.settled(outbox, outcomes, now).collect()}
    assert after[1].published_at == now and after[2].failed_at == now and after[2].attempts == 10
    assert after[3].available_at == now + datetime.timedelta(seconds=1) and after[3].last_error == "slow" and after[4].attempts == 1


def test_views_refuse_circles_and_refresh_downstream():
    views = logs.Views().define("c", ("b",), None).define("b", ("a",), None).define("d", ("x",), None)
    assert views.order() == ["b", "c", "d"] and views.order("a") == ["b", "c"] and views.order("b") == ["c"]
    with pytest.raises(ValueError, match="read each other"):
        views.define("b", ("c",), None).order()


def test_partition_starts():
    day = datetime.datetime(2024, 1, 2, 5)
    assert logs.partitions_needed(day, 86_400, 2) == [datetime.datetime(2024, 1, d) for d in (2, 3, 4)]


def test_once_skips_a_batch_that_the_ledger_has(spark, tmp_path):
    from millrace.streaming.once import once

    seen = []
    sink = once(lambda batch, number: seen.append(number), f"{tmp_path}/ledger")
    for number in (0, 1, 1, 0, 2):
        sink(spark.range(1), number)
    assert seen == [0, 1, 2]
