"""License scans against the SQL form and against regular expressions."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import licenses
from millrace.llm.licenses import ALL, AUTOMATA, PHRASES, TEMPLATES, Automaton, _expression, compiled, scan
from millrace.llm.shared import table

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def oracle(rows):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted((tuple(r) for r in db.execute(licenses.ORACLE_SQL).fetchall()), key=str)


def test_equals_sql_on_made_up_notices(spark):
    rng = random.Random(1)
    vocabulary = sorted({w for _, t in TEMPLATES for w in re.findall("[a-z0-9]+", t) if not w.isdigit()} | {"4", "0", "3", "é", "x"})
    rows = []
    for i in range(400):
        own = []
        for _ in range(rng.randint(0, 4)):
            _, template = rng.choice(TEMPLATES)
            template = re.sub(r"\[\[(.*?)\]\]", lambda m: m.group(1) if rng.random() < 0.5 else "", template)
            template = re.sub(r"\{\{(\d)\}\}", lambda m: " ".join(rng.choices(vocabulary, k=rng.randint(1, int(m.group(1)) + 1))), template)
            words = template.split()
            if rng.random() < 0.3:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            own += words + rng.choices(vocabulary, k=rng.randint(0, 3))
        rows.append((i, "".join(w.upper() if rng.random() < 0.2 else w.capitalize() if rng.random() < 0.3 else w for w in (x + rng.choice([" ", ", ", "\n", "-"]) for x in own))))
    assert rows_of(scan(spark.createDataFrame(rows, "doc_id long, text string"))) == oracle(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "?!"), (4, "CC-BY cc by"), (5, "cc"), (6, "all rights"), (6, "all rights"), (None, "All Rights Reserved."), (7, "ccby é all rights reserved " * 20_000), (8, "cc\x00by")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit(1)).withColumn("n_words", F.lit(2))
    got = {(r.doc_id, r.n_words): r for r in scan(df).collect()}
    assert got[(4, 4)].n_base == 2 and got[(4, 4)].last_word == 2 and got[(4, 4)].base_labels == "cc-by"
    assert got[(7, 100_000)].n_base == 20_000 and got[(8, 2)].base_labels == "cc-by" and got[(1, 0)].first_word is None
    assert rows_of(scan(df.filter("doc_id < 8"))) == oracle([r for r in rows if r[0] is not None and r[0] < 8])
    assert scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("automaton,template", list(zip(AUTOMATA, [t for _, t in TEMPLATES])))
def test_automaton_equals_expression(automaton, template):
    rng = random.Random(len(template))
    vocabulary = re.findall("[a-z0-9]+", re.sub(r"\{\{.*?\}\}", "", template))
    pattern = re.compile(_expression(template))
    for _ in range(300):
        words = [rng.choice(vocabulary + ["x"]) if rng.random() < 0.1 else w for w in vocabulary if rng.random() > 0.05] + rng.choices(vocabulary, k=rng.randint(0, 3))
        assert bool(automaton.accepts(words, 0)) == bool(pattern.match("".join(f" {w} " for w in words)))


def test_templates_need_two_leading_words():
    for bad in ("[[a]] b c", "a", "a b [[c"):
        with pytest.raises(ValueError):
            Automaton.compile("x", bad)
    assert set(PHRASES.values()) == {"cc-by", "gpl", "reserved"}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
GPL = """foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3
of the License, or (at your option) any later version. foo is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""


def test_whole_licence_texts(spark):
    changed = MIT.replace("sublicense", "rent")
    without = MIT.replace("MERCHANTABILITY", "USE")
    rows = [(1, MIT), (2, "x " * 500 + MIT), (3, changed), (4, without), (5, GPL), (6, GPL.replace("version 3", "version 2")), (7, GPL.replace("General", "Affero General"))]
    got = {r.doc_id: (r.labels.split(","), r.matches) for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = len(re.findall("[a-z0-9]+", MIT.lower()))
    assert f"mit-text:0:{words}" in got[1][1] and f"mit-text:500:{words}" in got[2][1]
    assert "mit-text" not in got[3][0]
    # The disclaimer is optional as a whole: with another wording it is not part of the match.
    assert "mit-text" in got[4][0] and f"mit-text:0:{words}" not in got[4][1]
    assert "gpl-3.0-notice" in got[5][0] and "gpl-2.0-notice" not in got[5][0] and "gpl-2.0-notice" in got[6][0] and "agpl-3.0-notice" in got[7][0]
    assert rows_of(scan(spark.createDataFrame(rows, "doc_id long, text string"))) == oracle(rows)


def test_templates_share_states_and_nothing_else():
    """All templates together accept what each accepts alone."""
    assert len(ALL.steps) < sum(len(a.steps) for a in AUTOMATA) - 100
    rng = random.Random(11)
    families = [("p", "a b c [[d]] e"), ("q", "a b c e"), ("r", "a b c {{2}} e"), ("s", "a b c d [[e [[f]] g]]"), ("t", "a b"), ("u", "a b c [[d]] [[d]] f")]
    together, alone = compiled(families), [(label, Automaton.compile(label, t)) for label, t in families]
    for _ in range(4000):
        words = ["a", "b", *rng.choices("abcdefg", k=rng.randint(0, 7))]
        assert together.found(words) == {label: n for label, a in alone if (n := a.accepts(words, 0))}
    vocabulary = sorted({w for _, t in TEMPLATES for w in re.findall("[a-z0-9]+", t)})
    for label, template in TEMPLATES:
        words = re.findall("[a-z0-9]+", re.sub(r"\{\{.*?\}\}", "x", template))
        for _ in range(20):
            own = [rng.choice(vocabulary) if rng.random() < 0.02 else w for w in words]
            expected = {}
            for (name, _), a in zip(TEMPLATES, AUTOMATA):
                if n := a.accepts(own, 0):
                    expected[name] = max(n, expected.get(name, 0))
            assert ALL.found(own) == expected


def test_documents_equal_sql(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert rows_of(scan(docs)) == oracle([tuple(r) for r in docs.select("doc_id", "text").collect()])
