"""Event stores, outboxes, dependent views and time partitions."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STREAM = ["aggregate_type", "aggregate_id"]


def appended(log: DataFrame, events: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, conflicts) of new events (aggregate_type, aggregate_id, seq, ...).

    ``expected`` has the version that the writer saw last per stream (-1: none). A stream whose latest
    version differs is a conflict and none of its events is taken. Versions go on from the latest.
    """
    now = log.groupBy(*STREAM).agg(F.max("version").alias("now"))
    checked = expected.join(now, STREAM, "left").withColumn("now", F.coalesce("now", F.lit(-1)))
    order = Window.partitionBy(*STREAM).orderBy("seq")
    fine = events.join(checked.filter("now = expected"), STREAM).withColumn("version", F.col("now") + F.row_number().over(order)).drop("now", "expected")
    return fine, checked.filter("now <> expected").select(*STREAM, "expected", "now")


def replay(log: DataFrame, from_version: int = 0) -> DataFrame:
    return log.filter(F.col("version") >= from_version).orderBy(*STREAM, "version")


def latest_versions(log: DataFrame) -> DataFrame:
    return log.groupBy(*STREAM).agg(F.max("version").alias("version"))


def since_snapshot(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Events after each stream's newest snapshot; all events of a stream without one."""
    newest = snapshots.groupBy(*STREAM).agg(F.max("version").alias("_seen"))
    return log.join(newest, STREAM, "left").filter(F.col("version") > F.coalesce("_seen", F.lit(-1))).drop("_seen")


def due(outbox: DataFrame, now, limit: int, max_attempts: int = 10) -> DataFrame:
    """The next unpublished events in id order whose time has come; a stream waits behind its oldest failure.

    ``outbox`` has id, aggregate_id, available_at, published_at, failed_at, attempts.
    """
    open_ = outbox.filter("published_at is null and failed_at is null")
    blocked = open_.filter((F.col("available_at") > F.lit(now)) & F.col("aggregate_id").isNotNull()).groupBy("aggregate_id").agg(F.min("id").alias("_from"))
    ready = open_.filter((F.col("available_at") <= F.lit(now)) & (F.col("attempts") < max_attempts))
    free = ready.join(blocked, "aggregate_id", "left").filter("_from is null or id < _from").drop("_from")
    return free.orderBy("id").limit(limit)


def settled(outbox: DataFrame, outcomes: DataFrame, now, max_attempts: int = 10, base_seconds: int = 1) -> DataFrame:
    """The outbox after a delivery round: ``outcomes`` has id, ok, error. Failures wait twice as long each time, then are dead."""
    o = outbox.join(outcomes.withColumnRenamed("ok", "_ok").withColumnRenamed("error", "_error"), "id", "left")
    tries = F.col("attempts") + F.when(F.col("_ok").isNotNull(), 1).otherwise(0)
    wait = F.make_dt_interval(secs=F.least(F.pow(F.lit(2.0), F.col("attempts")) * base_seconds, F.lit(3600.0)).cast("decimal(18,6)"))
    failed = F.coalesce(~F.col("_ok"), F.lit(False))
    dead = failed & (tries >= max_attempts)
    return o.select(
        *[c for c in outbox.columns if c not in ("published_at", "failed_at", "available_at", "attempts", "last_error")],
        F.when(F.col("_ok"), F.lit(now)).otherwise(F.col("published_at")).alias("published_at"),
        F.when(dead, F.lit(now)).otherwise(F.col("failed_at")).alias("failed_at"),
        F.when(failed & ~dead, F.lit(now) + wait).otherwise(F.col("available_at")).alias("available_at"),
        tries.alias("attempts"),
        F.when(failed, F.col("_error")).otherwise(F.col("last_error")).alias("last_error"),
    )


class Views:
    """Named views over others, refreshed so that each comes after all it reads."""

    def __init__(self):
        self._views: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {}

    def define(self, name: str, reads: tuple[str, ...], build: Callable[..., DataFrame]) -> Views:
        self._views[name] = (reads, build)
        return self

    def order(self, only_after: str | None = None) -> list[str]:
        """Views in dependency order; with ``only_after`` those alone that read it, however far down."""
        out: list[str] = []
        busy: list[str] = []

        def visit(name: str) -> None:
            if name in busy:
                raise ValueError(f"views read each other: {' > '.join([*busy, name])}")
            if name in self._views and name not in out:
                busy.append(name)
                for r in self._views[name][0]:
                    visit(r)
                busy.pop()
                out.append(name)

        for name in self._views:
            visit(name)
        if only_after is None:
            return out
        hit = {only_after}
        for name in out:
            if hit & set(self._views[name][0]):
                hit.add(name)
        return [n for n in out if n in hit and n != only_after]

    def refresh(self, tables: dict[str, DataFrame], only_after: str | None = None) -> dict[str, DataFrame]:
        """``tables`` and the refreshed views, by name; plans only, so Spark runs what is asked for."""
        out = dict(tables)
        for name in self.order(only_after):
            reads, build = self._views[name]
            out[name] = build(*[out[r] for r in reads])
        return out


def partitioned(df: DataFrame, time: str, seconds: int) -> DataFrame:
    """Rows with the start of their partition of fixed width, counted from the epoch."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    return df.withColumn("partition_start", F.timestamp_seconds((F.floor(micros / (seconds * 1_000_000)) * seconds).cast("long")).cast("timestamp_ntz"))


def partitions_needed(now: datetime.datetime, seconds: int, ahead: int) -> list[datetime.datetime]:
    """Starts of the current partition and the next ``ahead``."""
    first = int(now.replace(tzinfo=datetime.UTC).timestamp()) // seconds * seconds
    return [datetime.datetime.fromtimestamp(first + k * seconds, datetime.UTC).replace(tzinfo=None) for k in range(ahead + 1)]


def expired(df: DataFrame, time: str, now: datetime.datetime, seconds: int, keep_seconds: int) -> DataFrame:
    """Partitions that end before the retention begins."""
    limit = now - datetime.timedelta(seconds=keep_seconds + seconds)
    return partitioned(df, time, seconds).select("partition_start").distinct().filter(F.col("partition_start") <= F.lit(limit))
