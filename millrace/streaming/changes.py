"""Change data capture: records with versions, mirrors, latest-wins reads, verification, schema evolution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import (
    ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType, TimestampNTZType, TimestampType,
)

#: Versions are 64 bits without a sign: a seed loses to a clock time, which loses to a live sequence.
VERSION = DecimalType(20, 0)
LIVE, CLOCK = 1 << 63, 1 << 62


def live_version(sequence: Column) -> Column:
    return (sequence.cast(VERSION) + F.lit(str(LIVE)).cast(VERSION)).cast(VERSION)


def clock_version(at: Column) -> Column:
    return (F.unix_micros(at.cast("timestamp")).cast(VERSION) + F.lit(str(CLOCK)).cast(VERSION)).cast(VERSION)


def seed_version(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp")).cast(VERSION)


def normalized(changes: DataFrame, now: Column | None = None) -> DataFrame:
    """Changes (op, key, ..., version, at) with a clock version where there is none; other operations and null keys are errors."""
    known = F.col("op").isin("insert", "update", "delete") & F.col("key").isNotNull()
    checked = changes.withColumn("op", F.when(known, F.col("op")).otherwise(F.raise_error(F.lit("not a change: its operation or key is missing or unknown"))))
    return checked.withColumn("version", F.coalesce(F.col("version").cast(VERSION), clock_version(F.coalesce("at", now if now is not None else F.current_timestamp()))))


def latest(changes: DataFrame, keys: list[str], version: str = "version", deleted: Column | None = None) -> DataFrame:
    """The row of the highest version per key, then without the deleted ones: an old live row never comes back."""
    rest = [c for c in changes.columns if c not in keys]
    best = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row"))
    rows = best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in changes.columns])
    return rows.filter(~(F.col("op") == "delete" if deleted is None else deleted))


def pump(changes: DataFrame, sinks: list, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Deliver a stream of changes to every sink, batch by batch, at least once.

    A sink is a function (DataFrame, batch id) and must bear a batch twice. A sink that fails fails the
    batch, which comes again for all of them.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        own = normalized(batch).persist()
        try:
            for sink in sinks:
                sink(own, number)
        finally:
            own.unpersist()

    writer = changes.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def append_sink(path: str):
    """Writes each batch into a folder of its own number, so that a batch that comes again overwrites itself."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return apply


def digest(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the columns as canonical text: type-neutral, NULL apart from empty."""
    parts = [F.coalesce(F.concat(F.lit("="), _canonical(df.schema[c].dataType, F.col(c))), F.lit("~")) for c in columns]
    return F.sha2(F.to_json(F.array(*parts)), 256)


def _canonical(kind: DataType, value: Column) -> Column:
    if isinstance(kind, (FloatType, DoubleType)):
        # The shortest text that reads back as the same number; a float is widened by its text, and -0 is 0.
        return (value.cast("string").cast("double") + F.lit(0.0)).cast("string")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")).cast("string")
    return value.cast("string")


def verify_ranges(source: DataFrame, mirror: DataFrame, key: str, columns: list[str], width: int) -> DataFrame:
    """Key ranges of ``width`` whose row counts or digests differ: one aggregate row per range and side.

    Digests are summed in four parts of 28 bits, so that rows in several copies add up and do not cancel.
    """

    def folded(df: DataFrame, side: str) -> DataFrame:
        d = digest(df, columns)
        halves = [F.sum(F.conv(F.substring(d, F.lit(1 + 7 * k), F.lit(7)), 16, 10).cast("long")).alias(f"{side}_{k}") for k in range(4)]
        return df.groupBy(F.floor(F.col(key) / width).alias("range")).agg(F.count("*").alias(f"{side}_rows"), *halves)

    both = folded(source, "source").join(folded(mirror, "mirror"), "range", "full")
    same = F.col("source_rows").eqNullSafe(F.col("mirror_rows"))
    for k in range(4):
        same = same & F.col(f"source_{k}").eqNullSafe(F.col(f"mirror_{k}"))
    return both.filter(~same).select("range", F.coalesce("source_rows", F.lit(0)).alias("source_rows"), F.coalesce("mirror_rows", F.lit(0)).alias("mirror_rows"))


def divergences(source: DataFrame, mirror: DataFrame, key: str, columns: list[str], ranges: DataFrame | None = None, width: int = 1) -> DataFrame:
    """(key, kind) of rows that are missing in the mirror, extra in it, or different; within ``ranges`` if given."""

    def side(df: DataFrame, name: str) -> DataFrame:
        if ranges is not None:
            df = df.withColumn("range", F.floor(F.col(key) / width)).join(ranges.select("range"), "range", "left_semi")
        return df.select(F.col(key).alias("key"), digest(df, columns).alias(name))

    both = side(source, "a").join(side(mirror, "b"), "key", "full")
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "mismatch")
    return both.select("key", kind.alias("kind")).filter("kind is not null")


def point_id(*keys: str) -> Column:
    """The identifier of a key's point in a vector store: the same in every run, in the form of a UUID."""
    digest_ = F.md5(F.to_json(F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])))
    cut = lambda at, n: F.substring(digest_, F.lit(at), F.lit(n))
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def vector_changes(changes: DataFrame, keys: list[str], embed, payload: list[str], version: str = "version") -> DataFrame:
    """What a vector store must do for a batch: point_id, op (upsert or delete), vector, payload (JSON).

    Of a key's changes in the batch the latest alone counts, so upserts and deletes of a point are never
    out of order. ``embed`` takes the rows and returns them with a column ``vector``; deletes, and rows
    whose vector is NULL, are not embedded and delete their point.
    """
    last = latest(changes, keys, version, deleted=F.lit(False)).withColumn("point_id", point_id(*keys))
    live = embed(last.filter("op <> 'delete'"))
    there = F.col("vector").isNotNull()
    upserts = live.select("point_id", F.when(there, "upsert").otherwise("delete").alias("op"), "vector", F.when(there, F.to_json(F.struct(*payload))).alias("payload"))
    return upserts.unionByName(last.filter("op = 'delete'").select("point_id", "op"), allowMissingColumns=True)


def vector_sink(keys: list[str], embed, payload: list[str], upsert, delete):
    """A sink for ``pump``: ``delete`` and then ``upsert`` get the batch's points as DataFrames, each point in one of them."""

    def apply(batch: DataFrame, number: int) -> None:
        todo = vector_changes(batch, keys, embed, payload).persist()
        try:
            delete(todo.filter("op = 'delete'").select("point_id"), number)
            upsert(todo.filter("op = 'upsert'").drop("op"), number)
        finally:
            todo.unpersist()

    return apply


def mirror_schema(source: StructType, key: str) -> StructType:
    """The mirror's columns for a source: nested types and binary as text, then version and deleted."""
    keep = (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, DecimalType, DateType, TimestampType, TimestampNTZType, StringType)
    if key not in source.names:
        raise ValueError(f"no key column {key}")
    own = []
    for f in source.fields:
        plain = isinstance(f.dataType, keep) or f.dataType.simpleString() == "boolean"
        own.append(StructField(f.name, f.dataType if plain else StringType(), f.nullable and f.name != key))
    return StructType([*own, StructField("version", VERSION, False), StructField("deleted", ByteType(), False)])


_WIDER = {"tinyint": {"smallint", "int", "bigint"}, "smallint": {"int", "bigint"}, "int": {"bigint", "double"}, "float": {"double"}, "date": {"timestamp", "timestamp_ntz"}}


@dataclass(frozen=True)
class Step:
    action: str  # add, widen, relax, refuse, drop
    column: str
    detail: str = ""


def plan_evolution(live: StructType, wanted: StructType, allow_drop: tuple[str, ...] = ()) -> list[Step]:
    """What makes ``live`` fit ``wanted``: columns to add, types to widen, and what is refused because rows would be lost."""
    steps, old = [], {f.name: f for f in live.fields}
    for f in wanted.fields:
        have, kind = old.pop(f.name, None), f.dataType.simpleString()
        if have is None:
            steps.append(Step("add" if f.nullable or f.name in ("version", "deleted") else "refuse", f.name, kind if f.nullable else f"{kind} not null"))
        elif have.dataType != f.dataType:
            was = have.dataType.simpleString()
            wider = kind in _WIDER.get(was, ()) or kind == "string" or (isinstance(have.dataType, DecimalType) and isinstance(f.dataType, DecimalType) and f.dataType.scale >= have.dataType.scale and f.dataType.precision - f.dataType.scale >= have.dataType.precision - have.dataType.scale)
            steps.append(Step("widen" if wider else "refuse", f.name, f"{was} to {kind}"))
        elif f.nullable and not have.nullable:
            steps.append(Step("relax", f.name))
    return steps + [Step("drop" if c in allow_drop else "refuse", c, "" if c in allow_drop else "only in the mirror") for c in old]


def evolved(df: DataFrame, steps: list[Step], wanted: StructType) -> DataFrame:
    """Rows of the live mirror in the wanted schema; a refused step is an error."""
    if refused := [s for s in steps if s.action == "refuse"]:
        raise ValueError(f"refused: {', '.join(f'{s.column} ({s.detail})' for s in refused)}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields])


def backfill(source: DataFrame, key: str, at: Column) -> DataFrame:
    """Every source row as a seed change, which loses to any other change of its key."""
    return source.withColumn("key", F.col(key).cast("string")).withColumn("op", F.lit("insert")).withColumn("at", at).withColumn("version", seed_version(F.col("at")))


def stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
