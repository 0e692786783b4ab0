"""Vector search over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import vectors as v
from millrace.plans.registry import query

c = F.col
_QUERY = [round(((i * 7) % 13 - 6) / 10, 1) for i in range(64)]
_E = "SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings"
_Q = f"{_QUERY}::DOUBLE[]"
_DISTANCE = {
    "l2": f"list_distance(e, {_Q})",
    "l1": f"list_sum(list_transform(range(1, 65), lambda i: abs(e[i] - ({_Q})[i])))",
    "ip": f"-list_dot_product(e, {_Q})",
    "cosine": f"1 - list_cosine_similarity(e, {_Q})",
}


def _knn(metric):
    def run(t):
        return v.search(t.embeddings, "vec_id", "embedding", _QUERY, 10, metric).select("vec_id", F.round("distance", 6).alias("distance"))

    run.__name__ = f"knn_{metric}"
    query(f"SELECT vec_id, round({_DISTANCE[metric]}, 6) AS distance FROM ({_E}) ORDER BY {_DISTANCE[metric]}, vec_id LIMIT 10")(run)


for _metric in v.METRICS:
    _knn(_metric)


@query(f"SELECT vec_id, round({_DISTANCE['cosine']}, 6) AS distance FROM ({_E}) WHERE label IN (1, 3, 5) AND (label <> 3 OR label IS NULL) ORDER BY {_DISTANCE['cosine']}, vec_id LIMIT 7")
def knn_filtered(t):
    where = v.matching(c("label").isin(1, 3, 5), v.ne(c("label"), 3), v.matching_any())
    return v.search(t.embeddings, "vec_id", "embedding", _QUERY, 7, where=where).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round(1 - ({_DISTANCE['cosine']}), 6) AS score FROM ({_E}) WHERE {_DISTANCE['cosine']} <= 0.85 ORDER BY {_DISTANCE['cosine']}, vec_id LIMIT 500")
def knn_max_distance(t):
    return v.search(t.embeddings, "vec_id", "embedding", _QUERY, 500, most=0.85).select("vec_id", F.round(v.score("cosine", c("distance")), 6).alias("score"))


@query(f"SELECT vec_id FROM ({_E}) ORDER BY {_DISTANCE['l2']}, vec_id LIMIT 10 OFFSET 10")
def knn_page_2(t):
    last = v.search(t.embeddings, "vec_id", "embedding", _QUERY, 10, "l2").collect()
    if not last:
        return t.embeddings.select("vec_id").limit(0)
    return v.search(t.embeddings, "vec_id", "embedding", _QUERY, 10, "l2", after=(last[-1].distance, last[-1].vec_id)).select("vec_id")


@query(f"""WITH e AS ({_E}), m AS (SELECT i, avg(e[i]) FILTER (WHERE vec_id IN (1, 2)) AS p, avg(e[i]) FILTER (WHERE vec_id = 3) AS n FROM e, range(1, 65) r(i) WHERE vec_id IN (1, 2, 3) GROUP BY i),
    g AS (SELECT list(2 * p - n ORDER BY i) AS q FROM m) SELECT vec_id FROM e, g WHERE vec_id NOT IN (1, 2, 3) ORDER BY round(1 - list_cosine_similarity(e, q), 12), vec_id LIMIT 10""")
def recommend(t):
    return v.recommend(t.embeddings, "vec_id", "embedding", [1, 2], [3], 10).select("vec_id")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id > 40 AND label <> 2 ORDER BY vec_id LIMIT 25")
def scroll(t):
    return v.scroll(t.embeddings, "vec_id", 25, 40, v.ne(c("label"), 2)).select("vec_id", "label")


@query("""WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings), f AS (SELECT b AS g FROM b WHERE vec_id = 0)
    SELECT vec_id, len(list_filter(range(1, 65), lambda i: b[i] <> g[i])) AS hamming,
    round(1 - len(list_filter(range(1, 65), lambda i: b[i] AND g[i])) / len(list_filter(range(1, 65), lambda i: b[i] OR g[i])), 9) AS jaccard FROM b, f""")
def bit_distances(t):
    bits = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x > 0).alias("b"))
    first = bits.filter("vec_id = 0").select(c("b").alias("g"))
    return bits.crossJoin(F.broadcast(first)).select("vec_id", v.hamming(c("b"), c("g")).alias("hamming"), F.round(v.jaccard(c("b"), c("g")), 9).alias("jaccard"))
