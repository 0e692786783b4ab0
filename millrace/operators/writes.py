"""Writes as rewrites: each gives the table's new rows; `write` them to a new place and swap it in."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows by name; columns that ``rows`` lacks are NULL."""
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], update: Mapping[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT (keys): ``update`` maps columns to expressions over ``t`` (old) and ``excluded`` (new).

    None leaves old rows alone (DO NOTHING); ``where`` restricts which old rows are updated. Keys of
    ``rows`` must be distinct; NULL keys are equal to each other.
    """
    marked = table.withColumn("_old", F.lit(True)).alias("t"), rows.withColumn("_new", F.lit(True)).alias("excluded")
    both = marked[0].join(marked[1], [F.col(f"t.{k}").eqNullSafe(F.col(f"excluded.{k}")) for k in keys], "full")
    old, new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    changes = (old & new) if where is None else (old & new & F.coalesce(where, F.lit(False)))
    out = []
    for c in table.columns:
        fresh = F.col(f"excluded.{c}") if c in rows.columns else F.lit(None)
        kept = F.col(f"t.{c}")
        if update and c in update:
            kept = F.when(changes, update[c]).otherwise(kept)
        out.append(F.when(old, kept).otherwise(fresh).alias(c))
    return both.select(*out)


def update(table: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return table.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def update_from(table: DataFrame, source: DataFrame, keys: Mapping[str, str], values: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """UPDATE ... FROM: rows that meet a row of ``source`` take ``values``, expressions over ``t`` and ``s``.

    ``keys`` maps the table's columns to the source's, whose combinations must be distinct; NULLs meet
    nothing. ``where`` over both sides restricts the rows that change; rows that meet none stay.
    """
    on = [F.col(f"t.{a}") == F.col(f"s.{b}") for a, b in keys.items()]
    both = table.alias("t").join(source.withColumn("_met", F.lit(True)).alias("s"), on, "left")
    hit = F.col("_met").isNotNull() if where is None else F.col("_met").isNotNull() & F.coalesce(where, F.lit(False))
    return both.select(*[F.when(hit, values[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in values else F.col(f"t.{c}").alias(c) for c in table.columns])


def delete_using(table: DataFrame, source: DataFrame, on: Column | list[Column]) -> DataFrame:
    """DELETE ... USING: rows for which some row of ``source`` meets ``on``, over ``t`` and ``s``, go; no row is multiplied."""
    return table.alias("t").join(source.alias("s"), on, "left_anti").select(*[F.col(f"t.{c}") for c in table.columns])


def faults(rules: Mapping[str, Column]) -> Column:
    """The names of the rules that a row breaks, in their order; a rule whose value is NULL is broken."""
    return F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())


def validated(rows: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that may be written, and those that may not with the broken rules in ``faults``."""
    checked = rows.withColumn("faults", faults(rules))
    return checked.filter(F.size("faults") == 0).select(*rows.columns), checked.filter(F.size("faults") > 0)


def returning(table: DataFrame, where: Column, values: Mapping[str, Column], *columns: str) -> DataFrame:
    """The rows that an update changes, after it."""
    return update(table.filter(where), F.lit(True), values).select(*columns)


def delete(table: DataFrame, where: Column) -> DataFrame:
    return table.filter(~F.coalesce(where, F.lit(False)))


def soft_delete(table: DataFrame, where: Column, column: str, at: Column) -> DataFrame:
    """Marks rows instead of removing them; a mark that stands stays."""
    return update(table, where & F.col(column).isNull(), {column: at})


def increased(column: str, by) -> Column:
    return F.col(column) + by


def set_if_greater(column: str, value: Column) -> Column:
    return F.greatest(F.col(column), value)


def set_if_less(column: str, value: Column) -> Column:
    return F.least(F.col(column), value)


def changed(column: str, value: Column) -> Column:
    """TRUE where a value differs, NULLs compared as values."""
    return ~F.col(column).eqNullSafe(value)
