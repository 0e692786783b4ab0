"""Declared relations: semi and anti joins over them, counts, nested loads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HasMany:
    """Parents' ``key`` is children's ``foreign_key``."""

    children: DataFrame
    key: str
    foreign_key: str

    def links(self) -> DataFrame:
        return self.children.select(F.col(self.foreign_key).alias("_key"))

    def targets(self) -> DataFrame:
        return self.children.withColumn("_key", F.col(self.foreign_key))


@dataclass(frozen=True)
class ManyToMany:
    """Parents reach targets over a junction; a pair that stands there twice counts once."""

    junction: DataFrame
    key: str
    junction_parent: str
    junction_target: str
    target: DataFrame
    target_key: str

    def pairs(self) -> DataFrame:
        return self.junction.select(F.col(self.junction_parent).alias("_key"), F.col(self.junction_target).alias("_target")).filter("_key is not null and _target is not null").distinct()

    def links(self) -> DataFrame:
        return self.targets().select("_key")

    def targets(self) -> DataFrame:
        return self.target.join(self.pairs(), F.col(self.target_key) == F.col("_target")).drop("_target")


def where_has(parents: DataFrame, relation) -> DataFrame:
    links = relation.links()
    return parents.join(links, parents[relation.key] == links["_key"], "left_semi")


def where_doesnt_have(parents: DataFrame, relation) -> DataFrame:
    """Parents without a target; a NULL key has none."""
    links = relation.links()
    return parents.join(links, parents[relation.key] == links["_key"], "left_anti")


def with_count(parents: DataFrame, relation, name: str) -> DataFrame:
    """Parents with how many targets each has, 0 included; targets are counted before the join."""
    counts = relation.links().groupBy("_key").agg(F.count("*").alias(name))
    return parents.join(counts, parents[relation.key] == counts["_key"], "left").withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("long"))).drop("_key")


def limited_per_parent(targets: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Each parent's targets from ``offset`` on, ``limit`` at most, in a total ``order``."""
    place = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    return targets.withColumn("_place", place).filter((F.col("_place") > offset) & (F.col("_place") <= offset + limit)).drop("_place")


def load(parents: DataFrame, relation, name: str, columns: list[str], order: str, limit: int | None = None) -> DataFrame:
    """Parents with an array of structs of their targets, sorted by ``order``; empty for the childless.

    Give ``limit`` where a parent may have very many targets: an array is one row's value.
    """
    targets = relation.targets()
    if limit is not None:
        targets = limited_per_parent(targets, [F.col(order)], limit)
    nested = targets.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *columns))).alias("_rows"))
    out = parents.join(nested, parents[relation.key] == nested["_key"], "left").drop("_key")
    own = F.transform("_rows", lambda r: F.struct(*[r[c].alias(c) for c in columns]))
    return out.withColumn(name, F.coalesce(own, F.array().cast(f"array<struct<{','.join(f'{c}:{targets.schema[c].dataType.simpleString()}' for c in columns)}>>"))).drop("_rows")


def load_one(parents: DataFrame, relation: HasMany, name: str, columns: list[str], order: str) -> DataFrame:
    """Parents with a struct of their first target in ``order``, or NULL."""
    first = relation.targets().groupBy("_key").agg(F.min_by(F.struct(*columns), F.col(order)).alias(name))
    return parents.join(first, parents[relation.key] == first["_key"], "left").drop("_key")


def load_morph(rows: DataFrame, type_column: str, id_column: str, targets: dict[str, tuple[DataFrame, str]], name: str) -> DataFrame:
    """Rows with the JSON of the target that their type and id point at, each type in a table of its own."""
    out, found = rows, []
    for k, (kind, (target, key)) in enumerate(sorted(targets.items())):
        side = target.select(F.col(key).alias(f"_id{k}"), F.to_json(F.struct(*target.columns)).alias(f"_json{k}"))
        out = out.join(side, (F.col(type_column) == kind) & (F.col(id_column) == F.col(f"_id{k}")), "left").drop(f"_id{k}")
        found.append(f"_json{k}")
    return out.withColumn(name, F.coalesce(*found)).drop(*found)
