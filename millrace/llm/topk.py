"""Exact top-k by inner product with the threshold algorithm.

Candidates lie in blocks of bounded size. A block sorts its vectors once in
every dimension. For a query, the sorted lists are read in step, each from the
end that its weight favours; every vector met is scored in full, and after each
step the sum of the values last read bounds the score of all vectors not met.
A block stops when that bound falls below its kth best score; a tie goes on,
because a smaller id may still come. The blocks' best are merged by rank.

One block goes first, for all queries: its kth best score is one that the result
reaches in any case, so all other blocks may stop as soon as their bound falls
below it. Queries are cut into blocks as well, and a task is one pair of blocks,
so neither side is ever whole in one place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import written

#: Rows in a block of candidates and of queries. A candidate is copied once for each block of queries.
CANDIDATES, QUERIES = 8192, 4096
_FIRST_STEP = 8


def vectors(rows: DataFrame, id_column: str, vector_column: str, scale: int = 1024) -> DataFrame:
    """(id long, v array<long>): floor(scale * x) of every component, x as double.

    Rows without an id, null vectors and vectors with a null or non-finite component are left out.
    """
    x = F.col("x").cast("array<double>")
    own = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("x")).filter("id is not null and x is not null")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return own.filter(finite).select("id", F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c).cast("long")).alias("v"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def threshold_search(ids: np.ndarray, matrix: np.ndarray, order: np.ndarray, query: np.ndarray, own: int, k: int, reached: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows for one query, ties to smaller ids; ``order`` sorts each column upwards.

    Rows that score less than ``reached`` may be missing.
    """
    n = len(ids)
    dims = np.flatnonzero(query)
    seen = np.zeros(n, dtype=bool)
    best_ids, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    depth, step = 0, _FIRST_STEP
    falling, rising = dims[query[dims] > 0], dims[query[dims] < 0]
    while depth < n:
        stop = min(n, depth + step)
        if len(dims):
            met = np.concatenate([order[n - stop : n - depth, falling].ravel(), order[depth:stop, rising].ravel()])
            fresh = np.zeros(n, dtype=bool)
            fresh[met] = True
            new = np.flatnonzero(fresh & ~seen)
        else:
            new, stop = np.arange(n), n
        seen[new] = True
        new = new[ids[new] != own]
        if len(new):
            best_ids = np.concatenate([best_ids, ids[new]])
            best = np.concatenate([best, matrix[new] @ query])
            top = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[top], best[top]
        depth, step = stop, step * 2
        if seen.all():
            break
        last = np.concatenate([matrix[order[n - depth, falling], falling] * query[falling], matrix[order[depth - 1, rising], rising] * query[rising]])
        bound = last.sum()
        if len(best) == k and best[-1] > bound or reached is not None and reached > bound:
            break
    return best_ids, best


def _block(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    width = max([0, *map(len, candidates["v"]), *map(len, queries["v"])])
    matrix, ids = _matrix(candidates["v"], width), candidates["id"].to_numpy()
    order = np.argsort(matrix, axis=0, kind="stable")
    out = []
    for own, query, reached in zip(queries["id"].to_numpy(), _matrix(queries["v"], width), queries["reached"]):
        found, scores = threshold_search(ids, matrix, order, query, own, k, None if pd.isna(reached) else int(reached))
        out.append(pd.DataFrame({"query_id": own, "vec_id": found, "score": scores}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def _largest(rows: DataFrame) -> tuple[float, int]:
    """The largest size of a component, and the most components of a vector."""
    r = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("most"), F.max(F.size("v")).alias("width")).first()
    return r.most or 0.0, r.width or 0


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates by integer inner product.

    Both have id long and v array<long>, as ``vectors`` gives them; a candidate of the query's own id
    takes no part, and ties go to the smaller id. Shorter vectors count as ending in zeros. Of query
    rows that repeat an id the one of the least vector counts; candidate rows that repeat are ranked
    each. With fewer than k candidates all are returned, with none no row. Components whose inner
    products may not fit 64 bits are an error.
    """
    n, q = candidates.count(), queries.count()
    (a, width), (b, other) = _largest(queries), _largest(candidates)
    if a * b * max(min(width, other), 1) >= 2.0**63 * (1 - 1e-9):
        raise ValueError("components are so large that an inner product may not fit 64 bits")
    blocks, query_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-q // QUERIES))
    left = candidates.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = written(queries.groupBy("id").agg(F.min("v").alias("v")).select("id", "v", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("part")), "queries")

    def searched(which: DataFrame, first: int, last: int) -> DataFrame:
        own = which.withColumn("block", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
        pairs = left.filter(F.col("block").between(first, last)).groupBy("block", "part").cogroup(own.groupBy("block", "part"))
        return pairs.applyInPandas(lambda x, y: _block(x, y, k), "query_id long, vec_id long, score long")

    found = searched(asked.withColumn("reached", F.lit(None).cast("long")), 0, 0)
    if blocks > 1:
        found = written(found, "first-block")
        reached = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("reached")).filter(F.col("n") == k).select(F.col("query_id").alias("id"), "reached")
        found = found.unionByName(searched(asked.join(reached, "id", "left"), 1, blocks - 1))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
