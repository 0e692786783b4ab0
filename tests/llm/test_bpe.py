"""Encoding and decoding against the tokenizers library; the lexicon against a dictionary."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm.bpe import Encoder, Lexicon, Vocabulary, digests, encode, frequent_words
from millrace.llm.shared import table

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
WORDS = Vocabulary(PATH)
ENCODER = Encoder(WORDS, Lexicon.build(["the", "hello", "world"], WORDS.merge))


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def own(texts):
    ids, decoded = ENCODER.encode(pa.array(texts, pa.large_string()))
    return [(np.frombuffer(i.as_buffer(), "<u4").tolist(), d) for i, d in zip(ids, decoded)]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"]) | st.sampled_from("aAbé́'sST 0\n\t"), max_size=30), max_size=6))
def test_any_text(texts):
    assert own(texts) == [expected(t) for t in texts]


def test_every_code_point():
    """Assigned or not, between letters, alone and after a mark."""
    points = [c for c in [*range(0x32000), *range(0xE0000, 0xE0200), *range(0x10FF00, 0x110000)] if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b {chr(c)} é{chr(c)}\u0301" for c in points[k : k + 512]) for k in range(0, len(points), 512)]
    for text, got in zip(texts, own(texts)):
        assert got == expected(text)
    assert expected("a\u0558b")[0] == [320, 145, 502, 321]


def test_long_words_stay_out_of_the_lexicon(spark):
    """A word in many copies has no place there if it is long; its ids are the same."""
    long = "é" * 5000
    docs = spark.createDataFrame([(i, f"{long} the the") for i in range(20)], "doc_id long, text string")
    assert frequent_words(docs, PATH) == ["the"]
    assert {(r.n_tokens) for r in digests(docs, PATH).collect()} == {len(expected(f"{long} the the")[0])}


def test_chosen_texts():
    texts = ["", " ", "Hello  World!!", "it's I'LL don't", "a<|endoftext|>b <|startoftext|>", "ÀÉ é", "ΑΣ ΣΑΣ", "x" * 5000, "ab" * 30, "İstanbul ǅ", "1234 5,6", "a\xa0b　c", "\U0001f600\U0001f600"]
    assert own(texts) == [expected(t) for t in texts]
    assert own(["a", "b a"]) == own(["x", "a", "b a"])[1:]


def test_merging_many_equals_merging_each():
    rng = random.Random(8)
    words = ["".join(rng.choice("theaingor éß1!") for _ in range(rng.randint(1, 40))).replace(" ", "x") for _ in range(4000)] + ["a"]
    ids, at = WORDS.merge_many([w.encode() for w in words])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [WORDS.merge(w) for w in words]
    assert WORDS.merge_many([])[1].tolist() == [0]


def test_lexicon_is_minimal_and_exact(tmp_path):
    rng = random.Random(3)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(3000)}
    ids = {w: [rng.randrange(100) for _ in range(rng.randint(0, 4))] for w in words}
    lexicon = Lexicon.build(words, ids.__getitem__)
    (tmp_path / "lexicon").write_bytes(lexicon.to_bytes())
    mapped = Lexicon.map_file(str(tmp_path / "lexicon"))
    asked = [*words, "", "zz", "abcabcabcabc", *("".join(rng.choice("abcé") for _ in range(5)) for _ in range(500))]
    for word, place in zip(asked, mapped.places([w.encode() for w in asked])):
        assert (place >= 0) == (word in words)
        if place >= 0:
            assert mapped.ids[mapped.start[place] : mapped.start[place + 1]].tolist() == ids[word]
    # Minimal: no two states have the same future.
    futures, arcs = {}, {}
    for a, t in zip(lexicon.arc.tolist(), lexicon.target.tolist()):
        arcs.setdefault(a // 256, []).append((a % 256, t))

    def future(s):
        if s not in futures:
            futures[s] = (int(lexicon.final[s]), tuple((b, future(t)) for b, t in arcs.get(s, [])))
        return futures[s]

    assert len({future(s) for s in range(len(lexicon.final))}) == len(lexicon.final)
    assert Lexicon.build([], None).places([b"a"]).tolist() == [-1]


def test_documents(spark, sf):
    docs = table(spark, sf, "documents")
    texts = dict(docs.select("doc_id", "text").collect())
    rows = digests(docs, PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, decoded = expected(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "the the"), (3, "the the"), (None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("n", F.lit(2))
    got = sorted((r.doc_id or 0, r.ids, r.decoded) for r in encode(df, PATH).collect())
    assert got == sorted((i or 0, *expected(t)) for i, t in rows)
    assert encode(df.limit(0), PATH).count() == 0
