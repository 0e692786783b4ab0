"""Top-k against brute force, with ties, odd vectors and early stops."""

import numpy as np
import pytest

from millrace.llm import topk
from millrace.llm.queries import QUERIES
from millrace.llm.shared import table


def brute(rows, queries, k):
    out = []
    for i, q in queries:
        scored = sorted((-int(np.dot(q, v)), j) for j, v in rows if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("spread", [2, 1000])
def test_blocks_and_ties(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "CANDIDATES", 50)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(spread)
    rows = [(i, [int(x) for x in rng.integers(-spread, spread + 1, 6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = topk.top_k(df.filter("id % 15 = 0"), df)
    assert sorted(map(tuple, got.collect())) == brute(rows, [r for r in rows if r[0] % 15 == 0], 10)


def test_stops_early_when_one_dimension_rules():
    rng = np.random.default_rng(0)
    matrix = rng.integers(-3, 4, (2000, 5))
    matrix[:, 0] = rng.permutation(2000) * 100
    order, ids = np.argsort(matrix, axis=0, kind="stable"), np.arange(2000)

    class Counting(np.ndarray):
        rows = 0

        def __matmul__(self, other):
            Counting.rows += len(self)
            return np.asarray(self) @ other

    found, _ = topk.threshold_search(ids, matrix.view(Counting), order, np.array([50, 1, 0, -1, 0]), -1, 10)
    assert list(found) == list(np.lexsort((ids, -(matrix @ np.array([50, 1, 0, -1, 0]))))[:10]) and Counting.rows < 500


def test_embeddings(spark, sf):
    rows = [(r.vec_id, np.floor(1024 * np.array(r.embedding, dtype=np.float64)).astype(np.int64)) for r in table(spark, sf, "embeddings").collect()]
    got = QUERIES["op6_exact_topk"](spark, sf).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, [r for r in rows if r[0] % 100 == 0], 10)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (6, [-0.5]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>")
    own = topk.vectors(df, "vec_id", "e")
    assert sorted((r.id, list(r.v)) for r in own.collect()) == [(0, [1024, 2048]), (5, []), (6, [-512]), (7, [1024, 2048]), (7, [1024, 2048])]
    got = [tuple(r) for r in topk.top_k(own.filter("id = 0"), own, 3).orderBy("rank").collect()]
    assert got == [(0, 1, 7, 5242880), (0, 2, 7, 5242880), (0, 3, 5, 0)]
    assert topk.top_k(own.limit(0), own).count() == topk.top_k(own, own.limit(0)).count() == 0


def test_many_blocks_share_a_bound(spark, monkeypatch):
    """Blocks of seven candidates and three queries; scores with many ties."""
    monkeypatch.setattr(topk, "CANDIDATES", 7)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(8)
    vectors = [(int(i), [int(x) for x in rng.integers(-2, 3, 5)]) for i in rng.permutation(90)]
    rows = spark.createDataFrame(vectors, "id long, v array<long>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(rows.filter("id % 9 = 0"), rows, 4).collect()}
    for own, v in vectors:
        if own % 9 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in vectors if i != own)[:4]
            assert [got[(own, k)] for k in range(1, 5)] == [(i, -s) for s, i in best]


def test_sums_that_do_not_fit_are_refused(spark):
    rows = spark.createDataFrame([(1, [1e16, 1e16]), (2, [1e16, 1.0])], "id long, x array<double>")
    own = topk.vectors(rows, "id", "x")
    with pytest.raises(ValueError):
        topk.top_k(own, own)
    fits = topk.vectors(spark.createDataFrame([(1, [2.0**20, 0.0]), (2, [2.0**20, 1.0])], "id long, x array<double>"), "id", "x")
    assert [(r.query_id, r.score) for r in topk.top_k(fits, fits).collect()] == [(1, 2**60), (2, 2**60)]


def test_a_repeated_query_takes_its_least_vector(spark):
    rows = spark.createDataFrame([(1, [3]), (1, [2]), (4, [5])], "id long, v array<long>")
    assert [tuple(r) for r in topk.top_k(rows.filter("id = 1"), rows).collect()] == [(1, 1, 4, 10)]
