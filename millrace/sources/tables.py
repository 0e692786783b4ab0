"""Declared tables: where their files are, default filters, tenant scope, guards, readers and writers."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.session import checkpointed

TENANT = "millrace.tenant"


@dataclass(frozen=True)
class Table:
    """A named relation in a folder of Parquet, ORC, JSON or CSV files.

    Default filters hold for every scan unless they are lifted by name or all together; the tenant
    scope is not lifted by either. A missing tenant is an error, never a wide read.
    """

    name: str
    format: str = "parquet"
    schema: StructType | None = None
    filters: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    tenant_column: str | None = None
    guard: Callable[[DataFrame], Column] | None = None
    options: Mapping[str, str] = field(default_factory=dict)

    def with_filter(self, name: str, predicate: Callable[[], Column]) -> Table:
        return replace(self, filters={**self.filters, name: predicate})

    def soft_deleted_by(self, column: str) -> Table:
        """Rows whose ``column`` is set count as deleted."""
        return self.with_filter("soft_delete", lambda: F.col(column).isNull())

    def scoped_by_tenant(self, column: str) -> Table:
        return replace(self, tenant_column=column)

    def authorized_with(self, guard: Callable[[DataFrame], Column]) -> Table:
        return replace(self, guard=guard)

    def read(self, spark: SparkSession, folder: str) -> DataFrame:
        """All rows, without filters or scope."""
        reader = spark.read.format(self.format).options(**self.options)
        if self.schema is not None:
            reader = reader.schema(self.schema)
        return reader.load(f"{folder}/{self.name}.{self.format}")

    def scan(self, spark: SparkSession, folder: str, ignore: tuple[str, ...] | None = ()) -> DataFrame:
        """Rows that pass the default filters but those in ``ignore`` (None: all are lifted; unknown names lift nothing)."""
        df = self.read(spark, folder)
        for name, predicate in self.filters.items():
            if ignore is not None and name not in ignore:
                df = df.filter(predicate())
        if self.tenant_column:
            tenant = spark.conf.get(TENANT, None)
            if tenant is None:
                raise PermissionError(f"{self.name}: no tenant is set in {TENANT}")
            df = df.filter(F.col(self.tenant_column) == F.lit(tenant).cast(df.schema[self.tenant_column].dataType))
        return df.filter(self.guard(df)) if self.guard else df


def owner(column: str, subject) -> Callable[[DataFrame], Column]:
    """Rows whose ``column`` is the subject."""
    return lambda df: F.col(column) == F.lit(subject)


def member(members: DataFrame, resource: str, subject_column: str, subject, key: str) -> Callable[[DataFrame], DataFrame]:
    """Rows whose ``key`` is a resource of the subject in a membership table: a semi join, applied by calling it on the rows."""
    own = members.filter(F.col(subject_column) == F.lit(subject)).select(F.col(resource).alias("_resource"))
    return lambda df: df.join(own, df[key] == own["_resource"], "left_semi")


def shards(spark: SparkSession, folders: list[str], table: Table) -> DataFrame:
    """One table from many folders, by column name."""
    out = table.read(spark, folders[0])
    for folder in folders[1:]:
        out = out.unionByName(table.read(spark, folder), allowMissingColumns=True)
    return out


def numbered(df: DataFrame, name: str, order: list[str], start: int = 1) -> DataFrame:
    """Gapless numbers in ``order``, which must be total, without a single task: ranges are sorted apart and offset by their counts.

    The sorted rows are kept before they are counted: planned twice, each use would sample bounds of its own.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = checkpointed(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    # The id counts rows within a partition in its lower 33 bits.
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_id") - F.shiftleft(F.col("_part").cast("long"), 33) + F.col("_before") + start).drop("_part", "_id", "_before")


def any_of(*guards) -> Callable[[DataFrame], Column]:
    """One guard at least holds; none given: nothing does."""

    def predicate(df: DataFrame) -> Column:
        out = F.lit(False)
        for g in guards:
            out = out | g(df)
        return out

    return predicate


def all_of(*guards) -> Callable[[DataFrame], Column]:
    """Every guard holds; none given: nothing does."""

    def predicate(df: DataFrame) -> Column:
        if not guards:
            return F.lit(False)
        out = F.lit(True)
        for g in guards:
            out = out & g(df)
        return out

    return predicate


def write(df: DataFrame, path: str, format: str = "parquet", partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = (), mode: str = "error") -> None:
    """Write files; sorting within each file lets readers skip row groups by their statistics."""
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.format(format).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, keys: tuple[str, ...]) -> None:
    """A catalogue table whose rows lie by key, so later joins on the keys need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A table of another database, read in ranges of ``key`` by many tasks."""
    return spark.read.jdbc(url, table, key, low, high, partitions, properties=options)
