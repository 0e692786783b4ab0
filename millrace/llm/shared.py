"""Tables that a job writes once and reads again, in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; any other
    session is refused, because its executors could not read the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.conf.get("spark.master", "local") or "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/millrace-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


#: Where the tables of each open scope are; see ``scratch``.
_scopes: list[list[tuple[SparkSession, str]]] = []


#: Spark's own switch: a query's shuffle files are removed when it ends, not when the driver collects its plan.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str, keep: bool = False, tidy: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once.

    The table is removed at the end of the innermost ``scratch`` scope; without one, and with ``keep``, it stays.
    With ``tidy`` the shuffle files that it took are removed once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{label}"
    before = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true" if tidy else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    if _scopes and not keep:
        _scopes[-1].append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written_at"] = path
    return out


def removed(*tables: DataFrame) -> None:
    """Removes tables that ``written`` gave and nothing reads any more; others are left alone."""
    for df in tables:
        if "written_at" in df.__dict__:
            _remove(df.sparkSession, df.__dict__["written_at"])


def _file(spark: SparkSession, path: str):
    """A path and its file system, whatever Spark itself can write to."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    own, files = _file(spark, path)
    files.delete(own, True)


def written_bytes(spark: SparkSession, content: bytes, label: str) -> str:
    """Where ``content`` is now one file of the shared folder."""
    path = f"{shared_dir(spark)}-{label}"
    own, files = _file(spark, path)
    out = files.create(own)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that operators write within are removed at the end: write results out before it.

    ``with scratch(): near_duplicates(docs).write.parquet(place)``
    """
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            _remove(spark, path)


#: Keys whose rows ``join_counted`` sends to wherever their partners are: those with more than one in so many of all rows.
HOT_KEYS = 1 << 12


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], counted: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``keyed``, which has one row for each value of ``on`` and in ``counted`` how many of ``rows`` have it.

    Keys with more than one in ``HOT_KEYS`` of all counted rows are ``HOT_KEYS`` at most; they are
    broadcast, so a key that a third of the rows share stays spread over all tasks. The others meet
    in a shuffle. Keys are not null, and no other column is in both.
    """
    total = keyed.agg(F.coalesce(F.sum(counted), F.lit(0))).first()[0]
    hot = keyed.filter(F.col(counted) > total / HOT_KEYS)
    extra = [c for c in keyed.columns if c not in on]
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    near = marked.filter("_hot").drop("_hot")
    far = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keyed.filter(F.col(counted) <= total / HOT_KEYS), on, how)
    return near.select(*rows.columns, *extra).unionByName(far.select(*rows.columns, *extra))


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id as long and text as string, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
