"""Batches that run once: a ledger remembers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(sink: Callable[[DataFrame, int], None], ledger: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch that skips a batch whose number the ledger (a folder of Parquet files) has.

    The entry is written after the sink, so a crash between the two gives the batch again: the sink must bear that.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            done = not spark.read.schema("number long").parquet(ledger).filter(F.col("number") == number).isEmpty()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = False
        if not done:
            sink(batch, number)
            spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("append").parquet(ledger)

    return apply
