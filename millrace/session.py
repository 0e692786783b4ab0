"""Session settings that the engine's semantics rest on."""

from __future__ import annotations

import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession

#: Naive timestamps read as UTC, errors instead of silent NULLs, runtime re-planning.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; ``settings`` win, with dots for underscores in their names."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).getOrCreate()


@contextmanager
def scoped(spark: SparkSession, settings: dict[str, str]):
    """Settings that hold inside the block and are put back after it; names and values are checked first."""
    for name, value in settings.items():
        if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_.]*", name) or not re.fullmatch(r"[^\s;'\"]*", str(value)):
            raise ValueError(f"not a setting: {name}={value}")
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield spark
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors must share.

    Where that is unset, a local session gets a temporary folder and any other session is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.conf.get("spark.master", "local") or "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def one(df: DataFrame) -> Row:
    """The first row; no row is an error, more rows are left out."""
    row = df.first()
    if row is None:
        raise LookupError("no row")
    return row


def each(df: DataFrame, callback, prefetch: bool = True) -> int:
    """Rows one by one on the driver, a partition in memory at a time; how many there were."""
    n = 0
    for row in df.toLocalIterator(prefetchPartitions=prefetch):
        callback(row)
        n += 1
    return n
