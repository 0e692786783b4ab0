"""Packing: every id once, limits kept, no padding, ids as the tokenizers library gives them."""

import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm.packing import Limits, Packer, Piece, pack_documents
from millrace.llm.shared import table

SPECIAL = {"<|endoftext|>": 50256}


def packed(df, limits=Limits(), **more):
    ranks, library = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("tiktoken", "json"))
    return pack_documents(df, ranks, public_tokenizers.PATTERN, SPECIAL, limits=limits, library_path=library, **more)


def verify(rows, docs, limits=Limits()):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, t in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length, r.loss_tokens))
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        at = 0
        for start, length in sorted(own):
            assert start == at and length > 0
            at += length
        assert at == len(ids[i])
    for own in sequences.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(own) <= limits.segments and sum(x[2] for x in own) <= limits.loss
        assert at == limits.tokens or at & (at - 1) == 0
    return sequences


def test_documents(spark, sf):
    docs = table(spark, sf, "documents").repartition(2)
    rows = packed(docs).collect()
    sequences = verify(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sum(sum(p[1] for p in s) == 2048 for s in sequences.values()) > 0.9 * len(sequences)


def test_odd_texts(spark):
    texts = [None, "", " ", "\n\n  \n", "a<|endoftext|> b", "x  <|endoftext|>", "  　x", "it's ÉTÉ 123", "é" * 9000, "word " * 20_000, "\U0001f600" * 50]
    docs = list(enumerate(texts))
    verify(packed(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect(), docs)
    assert packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(None, "a", 1), (3, "b", 1), (3, "b", 1)], "doc_id long, text string, start int")
    assert sorted((r.doc_id or 0, r.length) for r in packed(twice).collect()) == [(0, 2), (3, 2), (3, 2)]


@pytest.mark.parametrize("limits", [Limits(256, 3, 256), Limits(256, 64, 100), Limits(64, 2, 40)])
def test_limits_hold_together(limits):
    rng = np.random.default_rng(4)
    packer, sequences, total = Packer(limits), [], 0
    for doc in range(400):
        n = int(rng.integers(1, 700))
        bears = rng.random(n) < rng.random()
        total += n
        sequences += packer.add(Piece(doc, np.arange(n), np.concatenate([[0], np.cumsum(bears)]), 0, n))
    sequences += packer.finish()
    assert sum(p.length for s in sequences for p in s) == total
    for s in sequences:
        size = sum(p.length for p in s)
        assert size <= limits.tokens and len(s) <= limits.segments and sum(p.loss_tokens for p in s) <= limits.loss


def test_long_runs_of_blanks(spark):
    """Far beyond what the pattern's look-ahead has stack for; a run under the switch is encoded alike by both."""
    texts = [" " * 1_200_000, "a" + "\n" * 5_000_000, "a" + " " * 1_500_000 + "b<|endoftext|> c", "　" * 30_000 + "x", "y" + "\t " * 9_999 + "z"]
    docs = list(enumerate(texts))
    verify(packed(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_many_short_texts_in_one_task():
    """Half a million empty texts are one demand: no placement looks at the pool piece by piece."""
    limits, ids, loss = Limits(), np.array([1], dtype="<u4"), np.zeros(2, dtype=np.int64)
    packer, began, pieces, sequences = Packer(limits), time.perf_counter(), 0, 0
    for doc in range(500_000):
        for s in packer.add(Piece(doc, ids, loss, 0, 1)):
            pieces, sequences = pieces + len(s), sequences + 1
    for s in packer.finish():
        pieces, sequences = pieces + len(s), sequences + 1
    assert pieces == 500_000 and sequences <= 500_000 // 64 + 10
    assert time.perf_counter() - began < 60


def test_loss_limit_binds_on_instruction_data(spark):
    """Prompts bear no loss: a limit below that on tokens decides, and sequences still fill up."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(600):
        prompt, answer = "question word " * int(rng.integers(1, 90)), "answer " * int(rng.integers(1, 60))
        rows.append((i, prompt + answer, len(prompt) if i % 10 else None))
    limits = Limits(tokens=512, segments=16, loss=200)
    df = spark.createDataFrame(rows, "doc_id long, text string, answer int").coalesce(1)
    got = packed(df, limits, answer_from="answer").collect()
    sequences = verify(got, [r[:2] for r in rows], limits)
    assert max(sum(p[2] for p in s) for s in sequences.values()) > 190
    assert sum(sum(p[1] for p in s) == 512 for s in sequences.values()) > 0.5 * len(sequences)
    # Loss-bearing ids: all that begin in the answer, and the end id.
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    loss = defaultdict(int)
    for r in got:
        loss[r.doc_id] += r.loss_tokens
    for i, text, at in rows:
        begins = [o[0] for o in tokenizer.encode(text).offsets]
        given = 1 if at is None else max(1, sum(b + (text[b] == " ") <= at and b < at for b in begins))
        assert abs(loss[i] - (len(begins) + 1 - given)) <= 1


def test_answer_place_counts_code_points(spark):
    docs = spark.createDataFrame([(1, "é é x y", 4), (2, "a b", 99), (3, "a b", -5), (4, None, 3), (5, "", None)], "doc_id long, text string, p int")
    loss = {r.doc_id: 0 for r in docs.collect()}
    for r in packed(docs.coalesce(1), answer_from="p").collect():
        loss[r.doc_id] += r.loss_tokens
    # Of "é é x y" the tokens " y" and the end begin at 4 or later ("é" may take two tokens, " x" begins at 3).
    assert loss == {1: 2, 2: 1, 3: 2, 4: 0, 5: 0}
