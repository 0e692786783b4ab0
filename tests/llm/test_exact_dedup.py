"""Exact deduplication against grouping by the whole text."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.exact_dedup import cuts, exact_duplicates
from millrace.llm.shared import table

SCHEMA = "doc_id long, text string"


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for i, text in rows:
        own = groups[text or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


@pytest.mark.parametrize("bits", [128, 3])
def test_equals_grouping_by_text_even_when_digests_clash(spark, bits):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh é\n") for _ in range(60_000))
    rows = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "a"), (5, "a"), (6, "A"), (7, long), (8, long), (9, long[:-1]), (10, "x" + long), (None, "a"), (None, "n"), (11, long[:40_000]), (12, "z" * 50_000)]
    rows += [(20 + i, f"text {i % 9}") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("recipe", F.lit(1)).withColumn("keep_id", F.lit("x"))
    assert got(exact_duplicates(df, bits)) == brute(rows)


def test_documents_and_no_rows(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(exact_duplicates(docs)) == brute(rows)
    assert exact_duplicates(docs.limit(0)).count() == 0


def test_cuts_are_bounded_and_move_only_near_an_edit():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 123, 300_000).astype(np.uint8)
    ends = cuts(raw)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(raw) and sizes.max() <= 16384 and sizes[:-1].min() >= 2048
    other = cuts(np.concatenate([raw[:1000], raw[900:]]))
    assert len(set(ends) & {e - 100 for e in other}) >= len(ends) - 3
    assert cuts(raw[:0]) == [] and cuts(raw[:5]) == [5]
