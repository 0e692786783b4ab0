"""Window frames and the functions that dialects define differently over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

START, HERE, END = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing


def over(partition: list[str], order: list[Column], rows: tuple[int, int] | None = None, values: tuple[int, int] | None = None) -> WindowSpec:
    """A window; ``rows`` is a frame by row count, ``values`` by the order key's value. GROUPS and EXCLUDE have functions of their own below."""
    spec = Window.partitionBy(*partition)
    if order:
        spec = spec.orderBy(*order)
    if rows is not None:
        return spec.rowsBetween(*rows)
    return spec.rangeBetween(*values) if values is not None else spec


def lag_in_frame(value: Column, spec: WindowSpec, offset: int, default: Column) -> Column:
    """The value ``offset`` rows before, or the type's default instead of NULL where there is none."""
    return F.coalesce(F.first(value).over(spec.rowsBetween(-offset, -offset)), default)


def lead_in_frame(value: Column, spec: WindowSpec, offset: int, default: Column) -> Column:
    return F.coalesce(F.first(value).over(spec.rowsBetween(offset, offset)), default)


def grouped_frame(df: DataFrame, partition: list[str], order: list[Column], start: int, end: int, rank: str = "_peers") -> tuple[DataFrame, WindowSpec]:
    """A frame of peer groups, GROUPS BETWEEN ``start`` AND ``end``: rows with the ordinal of their group in ``rank``, and a range over it."""
    numbered = df.withColumn(rank, F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    return numbered, Window.partitionBy(*partition).orderBy(rank).rangeBetween(start, end)


def sum_but_current(value: Column, partition: list[str], order: list[Column], start: int, end: int) -> Column:
    """SUM over ROWS BETWEEN ``start`` AND ``end`` EXCLUDE CURRENT ROW: NULL where no other row is in the frame."""
    spec = Window.partitionBy(*partition).orderBy(*order)
    parts = [F.sum(value).over(spec.rowsBetween(a, b)) for a, b in ((start, min(end, -1)), (max(start, 1), end)) if a <= b]
    if not parts:
        return F.lit(None)
    return F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0))))
