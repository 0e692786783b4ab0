"""Held-out accuracy, defined results for odd rows, and the models' building blocks."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import quality, toxicity
from millrace.llm.labels import fit_link, labelled, remainder, sigmoid
from millrace.llm.queries import QUERIES
from millrace.llm.shared import id_and_text, table
from millrace.llm.shingles import text_slices

SF = "/root/testdata/sf0.1"


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize("name,label,least", [("op4_toxicity", "toxic", 0.96), ("op9_quality", "quality", 0.97)])
def test_held_out(spark, name, label, least):
    out = QUERIES[name](spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(table(spark, SF, "labels"), "doc_id").filter("held_out").toPandas()
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.5) == (rows["predicted"] == 1)).all()
    y = rows[label].to_numpy()
    assert auc(rows["score"].to_numpy(), y) > least
    assert (rows["predicted"] == y).mean() > max(y.mean(), 1 - y.mean())
    assert out.count() == table(spark, SF, "documents").count()


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, module):
    texts = [None, "", " \n", "a", "!!!", "é" * 50_000, "one two " * 30]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, label string").withColumn("value", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)] + [(1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    rows = labelled(docs, labels, "quality")
    assert {r.doc_id: r.label for r in rows.collect()} == {i: i % 2 for i in range(6)}
    for model in (module.fit(rows, rows), module.fit(rows.limit(0), rows.limit(0)), module.fit(rows.filter("label = 1"), rows.filter("label = 1"))):
        out = module.score(docs, model)
        got = out.orderBy("doc_id").toPandas()
        assert len(got) == len(texts) and got["score"].between(0, 1).all() and out.columns == ["doc_id", "text", "label", "value", "score"]
        assert module.score(docs.limit(0), model).count() == 0
        ids = id_and_text(docs).unionByName(id_and_text(docs))
        assert module.score(ids, model).count() == 2 * len(texts)


def text_words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


class PlainModels:
    """Two Kneser-Ney models of continuation counts in plain Python."""

    def __init__(self, rows):
        seen = [{p for text, label in rows if bool(label) == bool(c) for p in zip(["", *text_words(text)], text_words(text))} for c in (0, 1)]
        self.counts = [Counter(w for _, w in own) for own in seen]
        self.shared = Counter(w for _, w in seen[0] | seen[1])
        self.freed = {}
        self.sums, self.all = [sum(n.values()) for n in self.counts], sum(self.shared.values())
        self.discounts = [toxicity.discounts(*(sum(n == k for n in own.values()) for k in (1, 2, 3, 4))) for own in self.counts]

    def p(self, c, word):
        n, total = self.counts[c], self.sums[c]
        off = lambda k: self.discounts[c][min(k, 3) - 1] if k else 0.0
        if c not in self.freed:
            self.freed[c] = sum(map(off, n.values())) / total if total else 1.0
        freed = self.freed[c]
        share = (self.shared[word] + 1 if word in self.shared else 1) / (self.all + len(self.shared) + 1)
        return (n[word] - off(n[word])) / max(total, 1) + freed * share

    def run(self, text):
        r = [math.log(self.p(1, w)) - math.log(self.p(0, w)) for w in text_words(text)]
        size = min(len(r), toxicity.WINDOW)
        return max(sum(r[i : i + size]) / size for i in range(len(r) - size + 1)) if r else 0.0


class PlainPairs(PlainModels):
    """Interpolated Kneser-Ney of word pairs over them, in plain Python."""

    def __init__(self, rows):
        super().__init__(rows)
        self.pairs = [Counter(p for text, label in rows if bool(label) == bool(c) for p in zip(["", *text_words(text)], text_words(text))) for c in (0, 1)]
        self.pair_discounts = [toxicity.discounts(*(sum(n == k for n in own.values()) for k in (1, 2, 3, 4))) for own in self.pairs]
        self.after = [{}, {}]
        for c in (0, 1):
            for (first, _), n in self.pairs[c].items():
                self.after[c].setdefault(first, []).append(n)

    def q(self, c, first, word):
        off = lambda k: self.pair_discounts[c][min(k, 3) - 1] if k else 0.0
        n, own = self.pairs[c][first, word], self.after[c].get(first)
        return (n - off(n)) / sum(own) + sum(map(off, own)) / sum(own) * self.p(c, word) if own else self.p(c, word)

    def pair(self, text):
        """Of the first run that is highest at the lower order."""
        words = text_words(text)
        r = [math.log(self.p(1, w)) - math.log(self.p(0, w)) for w in words]
        size = min(len(r), toxicity.WINDOW)
        if not r:
            return 0.0
        at = max(range(len(r) - size + 1), key=lambda i: (round(sum(r[i : i + size]), 9), -i))
        before = ["", *words]
        return sum(math.log(self.q(1, before[i], words[i])) - math.log(self.q(0, before[i], words[i])) for i in range(at, at + size)) / size


def mixed_rows(seed=4, n=240):
    rng = np.random.default_rng(seed)
    common, rare = [f"w{i}" for i in range(30)], [f"r{i}" for i in range(400)]
    rows = []
    for i in range(n):
        own = list(rng.choice(common, 25)) + list(rng.choice(rare[:200] if i % 3 == 0 else rare[200:], 4))
        rng.shuffle(own)
        rows.append((i, " ".join(own), int(i % 3 == 0)))
    return rows


def test_models_are_distributions_and_equal_plain_python(spark):
    rows = mixed_rows()
    table_, unknown = toxicity.word_model(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    got, plain = table_.toPandas(), PlainModels([(t, y) for _, t, y in rows])
    vocabulary = sorted({w for _, t, _ in rows for w in text_words(t)})
    assert len(got) == len(vocabulary) == len(plain.shared)
    for c in (0, 1):
        assert abs(got[f"p{c}"].sum() + unknown[c] - 1) < 1e-12
        assert np.allclose(sorted(got[f"p{c}"]), sorted(plain.p(c, w) for w in vocabulary), rtol=1e-12, atol=0)
        assert abs(unknown[c] - plain.p(c, "never")) < 1e-15


@pytest.mark.parametrize("vocabulary", [toxicity.VOCABULARY, 20, 0])
def test_evidence_equals_plain_python(spark, vocabulary):
    """Whatever is sent to workers: all words, a few or none."""
    rows = mixed_rows()
    plain = PlainModels([(t, y) for _, t, y in rows])
    model = toxicity.count_models(spark.createDataFrame(rows, "doc_id long, text string, label int"), vocabulary)
    assert len(model.words) <= vocabulary and len(model.words) + model.rest.count() == len(plain.shared)
    texts = [r[1] for r in rows] + ["r3 r3 r3 r3 w1", "never seen r7 words", "r7", "never", "", None, "r1 r2", " ".join(r[1] for r in rows) + " r5 r6"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.run, r.n) for r in toxicity.evidence(docs, model).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert abs(got[i][0] - plain.run(text)) < 1e-9 and got[i][1] == len(text_words(text))


def test_evidence_of_real_texts_equals_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    rows = labelled(docs, table(spark, sf, "labels"), "toxic")
    plain = PlainModels([(r.text, r.label) for r in rows.collect()])
    model = toxicity.count_models(rows, 500)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.evidence(docs, model).collect():
        assert abs(r.run - plain.run(texts[r.doc_id])) < 1e-9


def test_pairs_are_distributions_after_every_word(spark):
    """The highest order: discounted shares, and what they free to the lower one; after words that no row holds, the lower one itself."""
    rows = mixed_rows()
    order = toxicity.count_models(spark.createDataFrame(rows, "doc_id long, text string, label int")).order
    plain = PlainPairs([(t, y) for _, t, y in rows])
    assert order.pairs.count() == len(plain.pairs[0] | plain.pairs[1]) and order.contexts.agg(F.sum("s0"), F.sum("s1")).first() == tuple(sum(n.values()) for n in plain.pairs)
    firsts = order.contexts.select("first").union(spark.createDataFrame([(7,)], "first long"))
    seconds = order.words.select(F.col("key").alias("second")).union(spark.createDataFrame([(7,)], "second long"))
    for few in (False, True):
        got = order.valued(firsts.crossJoin(seconds), few).groupBy("first").agg(F.sum("q0").alias("q0"), F.sum("q1").alias("q1")).toPandas()
        assert len(got) == len({first for own in plain.pairs for first, _ in own}) + 1
        assert np.allclose(got[["q0", "q1"]], 1, atol=1e-9)


@pytest.mark.parametrize("vocabulary", [toxicity.VOCABULARY, 20, 0])
def test_pair_evidence_equals_plain_python(spark, vocabulary):
    """Both orders of the run, whatever is sent to workers; ties go to the first run."""
    rows = mixed_rows()
    plain = PlainPairs([(t, y) for _, t, y in rows])
    model = toxicity.count_models(spark.createDataFrame(rows, "doc_id long, text string, label int"), vocabulary)
    texts = [r[1] for r in rows] + ["w1 r3 r3 w2 r3 r3 r3 w1", "never seen r7 words", "r7", "never", "", None, "r1 r2", "w3 never w4 never w5", " ".join(r[1] for r in rows)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.pair for r in toxicity.evidence(docs, model).collect()}
    assert len(got) == len(texts) and len({round(x, 6) for x in got.values()}) > len(rows) / 2
    for i, text in enumerate(texts):
        assert abs(got[i] - plain.pair(text)) < 1e-9, text


def test_the_score_takes_the_pairs(spark):
    """Where both classes have the same words after the same number of others, only the pairs' places tell the texts apart."""
    rows = [(i, ("a b c d a b c d a c b d" if i % 2 else "a c b d a c b d a b c d"), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df.filter("doc_id < 40"), df.filter("doc_id >= 40"))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert all((got[i] > 0.5) == bool(y) for i, _, y in rows)


def test_evidence_alone_tells(spark):
    """Held-out AUC of the length-normalised difference itself, without the length."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = labelled(docs, labels, "toxic").withColumn("part", remainder(5))
    model = toxicity.count_models(rows.filter("part between 1 and 3"))
    got = toxicity.evidence(rows.filter("part = 0"), model).join(labels, "doc_id").toPandas()
    assert auc(got["run"].to_numpy(), got["toxic"].to_numpy()) > 0.95


def test_repeats_do_not_count(spark):
    """A line or a document with copies makes no new continuations; the order of rows is of no matter."""
    rows = mixed_rows(n=60)
    more = [(i + 100, t + " " + t, y) for i, t, y in rows] + rows
    schema = "doc_id long, text string, label int"
    one, two = (sorted(map(tuple, toxicity.word_model(spark.createDataFrame(x, schema))[0].select("key", "total").collect())) for x in (rows + rows, rows))
    assert one == two
    assert toxicity.word_model(spark.createDataFrame(more, schema))[0].agg(F.sum("total")).first()[0] <= sum(n for _, n in two) + len(rows)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_score_column_must_be_new(spark, module):
    docs = spark.createDataFrame([(1, "a b", 1)], "doc_id long, text string, Score int")
    rows = spark.createDataFrame([(1, "a b", 1), (2, "c d", 0)], "doc_id long, text string, label int")
    model = module.fit(rows, rows)
    with pytest.raises(ValueError):
        module.score(docs, model)
    assert module.score(docs, model, "other").columns == ["doc_id", "text", "Score", "other"]


def test_toxic_word_makes_the_evidence(spark):
    rng = np.random.default_rng(1)
    clean = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(200):
        own = list(rng.choice(clean, 40))
        if i % 4 == 0:
            own[rng.integers(40)] = "slur"
        rows.append((i, " ".join(own), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df.filter("doc_id < 150"), df.filter("doc_id >= 150"))
    tests = spark.createDataFrame([(0, "w1 w2 slur w3"), (1, "w1 w2 w4 w3")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(tests, model).collect()}
    assert got[0] > 0.5 > got[1]


def test_scores_do_not_depend_on_what_is_sent(spark):
    """No word is cut: workers that get two words, or few, give the scores of those that get all."""
    rows = mixed_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    telling = Counter(w for _, t, y in rows[:180] if y for w in t.split() if w[0] == "r").most_common(1)[0][0]
    texts = [r[1] for r in rows[:60]] + [f"{telling} " * 10 + "w1", "never seen r7 words", "", None, rows[0][1]]
    tests = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def scores(**limits):
        model = toxicity.fit(df.filter("doc_id < 180"), df.filter("doc_id >= 180"), **limits)
        return model, np.array([r.score for r in toxicity.score(tests, model).orderBy("doc_id").collect()])

    model, whole = scores()
    assert len(model.words) > 300 and model.rest.isEmpty()
    for vocabulary in (2, 30):
        model, cut = scores(vocabulary=vocabulary)
        assert len(model.words) <= vocabulary and not model.rest.isEmpty()
        assert np.allclose(cut, whole, atol=1e-9)
    assert whole[60] > 0.5


def test_discriminant_equals_plain_numpy(spark):
    """Evidence against log-densities from whole covariances, without factors kept or sums over tasks."""
    import pyarrow as pa

    sf = "/root/testdata/sf0.01"
    rows = labelled(table(spark, sf, "documents"), table(spark, sf, "labels"), "quality").repartition(5)
    model = quality.fit(rows, rows.limit(0), to_pooled=0.1, to_identity=0.01)
    own = rows.toPandas()
    x = np.concatenate([quality.statistics(raw, at) for _, _, raw, at in text_slices(pa.array(own["text"].tolist()))])
    y = own["label"].to_numpy() > 0
    means, spread = [x[y == bool(c)].mean(axis=0) for c in (0, 1)], [np.cov(x[y == bool(c)].T, bias=True) for c in (0, 1)]
    pooled = sum(spread[c] * (y == bool(c)).sum() for c in (0, 1)) / len(x)
    density = []
    for c in (0, 1):
        shrunk = 0.9 * spread[c] + 0.1 * pooled
        shrunk = 0.99 * shrunk + 0.01 * (np.trace(shrunk) / x.shape[1] + 1e-6) * np.eye(x.shape[1])
        away = x - means[c]
        density.append(-(np.einsum("ij,ji->i", away, np.linalg.solve(shrunk, away.T)) + np.linalg.slogdet(shrunk)[1]) / 2)
    plain = density[1] - density[0] + np.log((y.sum() + 1) / ((~y).sum() + 1))
    got = model.evidence(x)
    assert np.abs(got - plain).max() < 1e-6 * max(1, np.abs(plain).max())


def test_statistics_see_each_text_alone():
    import pyarrow as pa

    texts = ["One two. THREE!", "", "x | y | z", "é é é é é é", "a" * 500]
    both = np.concatenate([quality.statistics(raw, at) for _, _, raw, at in text_slices(pa.array(texts))])
    alone = np.concatenate([quality.statistics(raw, at) for t in texts for _, _, raw, at in text_slices(pa.array([t]))])
    assert np.allclose(both, alone) and np.isfinite(both).all()


def test_link():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < sigmoid(2 * x[:, 0] - 1)).astype(float)
    assert np.allclose(fit_link(x, y), [2, 0, -1], atol=0.25)


def test_remainder(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in [*range(30), -5, None]], "doc_id long").withColumn("r", remainder(5))
    assert all(r.r == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5) for r in df.collect())


@pytest.mark.parametrize("text", [True, False])
def test_columns_of_any_name_pass(spark, text):
    """Names that the scorer uses itself, one with a dot, rows that repeat, and a null id."""
    names = ["n", "top", "open", "row", "run", "own", "key", "ratio", "mark", "label", "a.b"]
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    rows = spark.createDataFrame([(1, "a b", 1), (2, "c d", 0), (3, "a d", 1), (4, "c e", 0)], "doc_id long, text string, label int")
    out = toxicity.score(docs, toxicity.fit(rows, rows, 1), text=text)
    assert out.columns == ["doc_id", *["text"] * text, *names, "score"]
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "None"] and all(r["a.b"] == 10 for r in out.collect())
