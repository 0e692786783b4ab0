"""Personal data against the base patterns run by a regular expression engine."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm.pii import BASE, detect, find_spans, luhn, redact, redacted, summary
from millrace.llm.shared import table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind in BASE:
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


def base(text):
    return [s for s in find_spans(text) if s[0] in BASE]


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("aZ09.@-+% ()é_12345"), max_size=60))
def test_base_kinds_equal_their_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4785380592391139", "4111 1111 1111 1111", "a@b.c", "@", ".", "+1 (743) 555-3824", "192.168.0.1", "300.1.1.1", " ", "-", "x", "1.2.3", "0", "é", "+"]), max_size=12))
def test_base_kinds_equal_their_patterns_on_joined_parts(parts):
    assert base("".join(parts)) == brute("".join(parts))


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("see https://example.com/a?b=1, now", "url", "https://example.com/a?b=1"),
        ("IBAN: GB82 WEST 1234 5698 7654 32 please", "account", "GB82 WEST 1234 5698 7654 32"),
        ("account no. 12345678 x", "account", "12345678"),
        ("SSN 123-45-6789.", "account", "123-45-6789"),
        ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
    ],
)
def test_added_kinds(text, kind, found):
    assert [text[a:b] for k, a, b in find_spans(text) if k == kind] == [found]


def test_no_added_kind_without_validation():
    assert not [s for s in find_spans("http:// iban DE00 1234 5678 9012 3456 78 account holders token economy ssn 12") if s[0] not in BASE]


def test_any_letter_after_a_cue():
    """Letters outside ASCII fold to ASCII ones under some rules: none of them is part of an account."""
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).lower() != chr(c).upper()] + list("İıſK")
    for cue in ("iban", "account", "acct", "ssn", "token", "secret", "api_key"):
        for c in letters:
            find_spans(f"{cue} {c}B82WEST12345698765432")
    for c in "İK":
        assert not [s for s in find_spans(f"iban {c}B82WEST12345698765432") if s[0] == "account"]
        assert base(f"iban {c}B82WEST12345698765432 a@b.cd") == brute(f"iban {c}B82WEST12345698765432 a@b.cd")


def test_cues_in_any_capitals():
    for cue in ("iban", "IBAN", "Iban", "IbAN", "iBaN"):
        assert [s[0] for s in find_spans(f"{cue} GB82WEST12345698765432")] == ["account"]
    assert [s[0] for s in find_spans("see HtTpS://example.com/")] == ["url"]
    assert "secret" in [s[0] for s in find_spans("ToKeN: 24be64439e3e49cf46b2d7c90f3602a3")]


def test_cues_within_a_long_run_are_read_once():
    for text in ("token" * 200_000 + "1", "+1" * 300_000, "a@" * 300_000, "iban " * 200_000, "http://" * 100_000, "1.2." * 200_000, "account" + " \t" * 500_000):
        find_spans(text)
    assert [s for s in find_spans("token" * 10 + "1") if s[0] == "secret"] == [("secret", 5, 51)]


def test_documents(spark, sf):
    docs = table(spark, sf, "documents")
    texts = dict(docs.select("doc_id", "text").collect())
    rows = summary(docs).collect()
    assert len(rows) == len(texts) and sum(r.n_email + r.n_phone for r in rows) > 0
    for r in rows:
        own = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in own).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in own) for k in BASE]


def test_odd_rows_and_redaction(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a@b.cd", "x"), (3, "é a@b.cd +1 (743) 555-3824!", "x"), (3, "é a@b.cd +1 (743) 555-3824!", "x"), (4, "9" * 200_000 + "@" * 1000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("n_ip", F.lit(0))
    assert sorted(str(r.text) for r in redact(df).collect() if r.doc_id != 4) == sorted(["None", "", "[EMAIL]", "é [EMAIL] [PHONE]!", "é [EMAIL] [PHONE]!"])
    assert redact(df).columns == df.columns
    assert {r.doc_id: r.spans for r in summary(df).collect()}[3] == "email:2:8,phone:9:26"
    assert len(detect(df).collect()) == 6 and detect(df.limit(0)).count() == summary(df.limit(0)).count() == redact(df.limit(0)).count() == 0
    assert redacted("abcdef", [("ip", 1, 3), ("card", 2, 4)]) == "a[IP]ef"
