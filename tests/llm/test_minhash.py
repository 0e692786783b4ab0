"""Near-duplicates against brute force over whole shingle sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import minhash
from millrace.llm.components import components
from millrace.llm.minhash import intersections, near_duplicates, signatures
from millrace.llm.shared import table

SCHEMA = "doc_id long, text string"


def brute(rows, percent=85, width=5):
    def lower(s):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)

    sets = []
    for _, text in rows:
        words = [lower(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in where.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(rows[a][0]), find(rows[b][0])
            root[max(x, y)] = min(x, y)
    return sorted((r[0], len(s), find(r[0]), find(r[0]) == r[0]) for r, s in zip(rows, sets))


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_families_of_near_copies(spark):
    rng = random.Random(5)
    rows, vocabulary = [], [f"w{i}" for i in range(400)]
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(14):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    assert got(near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").filter(F.length("text") < 3000)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(near_duplicates(docs)) == brute(rows)


def test_all_documents(spark):
    """Whole texts of every length."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert got(near_duplicates(docs)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def crowd(rng, families, copies, most):
    """Families of copies with up to ``most`` words changed, all with one long passage in common: crowded buckets of several components."""
    passage, rows = [f"p{i}" for i in range(150)], []
    for family in range(families):
        own = [f"f{family}x{i}" for i in range(14)]
        for _ in range(copies):
            words = passage + own
            for _ in range(rng.randint(0, most)):
                words[rng.randrange(len(words))] = f"c{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows_,shingles", [(3, 10**6), (16, 2000), (1024, 10**6)])
@pytest.mark.parametrize("percent", [85, 92])
def test_crowded_buckets_in_blocks_of_any_size(spark, monkeypatch, rows_, shingles, percent):
    """Blocks of three rows make components larger than a block, mixed blocks and pairs of both."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", rows_)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
    rows = crowd(random.Random(9), 9, 12, 4)
    expected = brute(rows, percent)
    assert len({r[2] for r in expected}) > (1 if percent == 85 else 9)
    assert got(near_duplicates(spark.createDataFrame(rows, SCHEMA), percent)) == expected


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, int(n)).astype(np.uint64)) for n in rng.integers(1, 6000, 12)]
    assert intersections(sets[:5], sets[5:]).tolist() == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]
    assert intersections([np.array([1], dtype=np.uint64)], [np.array([2], dtype=np.uint64)]).tolist() == [[0]]


@pytest.mark.parametrize("percent", [85, 87, 90])
def test_recall_of_planted_pairs(spark, percent):
    """2,000 pairs at just the similarity that counts: banding alone may lose one, with a chance of 8e-7 each."""
    rows, both = [], 17 * 12
    for i in range(2000):
        # both / (both + 2 * ends) is at or just above the percentage.
        ends = int(both * (100 - percent) / percent / 2)
        common = [f"w{i}x{k}" for k in range(both + 4)]
        rows += [(2 * i, " ".join(common + [f"a{i}x{k}" for k in range(ends)])), (2 * i + 1, " ".join(common + [f"b{i}x{k}" for k in range(ends)]))]
    found = got(near_duplicates(spark.createDataFrame(rows, SCHEMA), percent=percent))
    assert sum(not r[3] for r in found) == 2000


def test_a_bucket_of_many_distinct_near_copies(spark):
    """20,000 copies of one text with a word changed are one family, found by one comparison each and not by their pairs."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[: i % 60] + [f"c{i}"] + words[i % 60 + 1 :])) for i in range(20_000)]
    # The unchanged text has the least doc_id.
    out = near_duplicates(spark.createDataFrame([(-1, " ".join(words)), *rows], SCHEMA), percent=80)
    assert out.filter("component_id = -1").count() > 20_000


def test_pairs_at_a_threshold_of_80(spark):
    """1,000 pairs of 90 shingles each, 80 of them shared: a Jaccard of exactly 0.80."""
    rows = []
    for i in range(1000):
        both, ends = [f"w{i}x{k}" for k in range(84)], [[f"{side}{i}x{k}" for k in range(10)] for side in "ab"]
        rows += [(2 * i, " ".join(both + ends[0])), (2 * i + 1, " ".join(both + ends[1]))]
    found = got(near_duplicates(spark.createDataFrame(rows, SCHEMA), percent=80))
    assert found == brute(rows, percent=80) and sum(r[3] for r in found) == 1000


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One  two"), (5, "one two"), (6, "one two three"), (7, "é É"), (8, "É é"), (9, "a b c d e"), (9, "a b c d e"), (10, "A B\vC D\x0cE")]
    assert got(near_duplicates(spark.createDataFrame(rows, SCHEMA))) == [
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 8, True),
        (9, 1, 9, True), (9, 1, 9, True), (10, 1, 9, False),
    ]


def test_clashing_names_null_ids_one_id_of_two_texts_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, "x"), (4, text, "x"), (4, text + " more", "x"), (5, text + " more", "x"), (None, "alone", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string").withColumn("sig", F.lit(1)).withColumn("component_id", F.lit(0))
    out = near_duplicates(df)
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out.collect()) == [(0, 0, True), (0, 4, False), (4, 4, True), (4, 4, True), (5, 4, False)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_one_very_long_text(spark):
    text = " ".join(f"w{i % 9973}x{i % 101}" for i in range(300_000))
    rows = [(1, text), (2, text + " end"), (3, "short")]
    assert [r[2] for r in got(near_duplicates(spark.createDataFrame(rows, SCHEMA)))] == [1, 1, 3]


@pytest.mark.parametrize("share", [0.5, 0.85])
def test_signatures_estimate_similarity(share):
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(200):
        n = 300
        both = int(round(2 * n * share / (1 + share)))
        pool = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
        sig = signatures([pool[:n], pool[n - both :]], 120)
        errors.append((sig[0] == sig[1]).mean() - share)
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 1.3 * np.sqrt(share * (1 - share) / 120)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(7, 7), (3, 1), (None, 5)]
    out = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert out == {i: 100 for i in range(100, 161)} | {k: 1 for k in range(1, 40)}
