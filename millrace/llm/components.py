"""Connected components of an undirected graph whose edges are a DataFrame.

Alternates two local contractions, each a group minimum and a join: every node
hands its larger neighbours to the smallest one, then every node links its
smaller neighbours to the smallest. Rounds grow with the logarithm of the
longest path. Only counts reach the driver; no neighbour list is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import removed, written


def _to_smallest(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """Edges (a, b) rewritten onto the least of a's neighbours and a itself."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = edges.join(least, "a")
    if keep_larger:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    kept = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long): the least node reachable.

    Loops, repeated edges and either direction are allowed; an edge with a null end is ignored.
    """
    now = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b and a is not null and b is not null")
        .distinct(),
        "edges",
    )
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_smallest(both, keep_larger=True).filter("a <> b").distinct()
        before, now = now, written(_to_smallest(large, keep_larger=False).distinct(), "edges")
        removed(before)
        after = now.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("decimal(20,0)")).alias("h"), F.sum(F.col("b").cast("decimal(30,0)")).alias("s")).first()
        if after == state:
            break
        state = after
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
