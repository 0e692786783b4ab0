"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
URL schemes and identifier cues. Each anchor starts a small deterministic
parser that expands it to the left and right and validates what it found. No
parser looks at a place twice for one kind, so the work is linear in the text.

Base kinds are exactly the leftmost non-overlapping matches, kind by kind, of

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
    card   [0-9]([\\x20-]?[0-9])+, 12 to 19 digits passing Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9], 9 to 15 digits

where a match that fails its check is dropped without another try. The method
adds url, account (an IBAN, account or social security number after its cue)
and secret (a long key after ``token``, ``secret`` or ``api_key``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")
SCHEMES = ("http://", "https://", "ftp://")
ACCOUNT_CUES = ("iban", "account", "acct", "ssn")
SECRET_CUES = ("token", "secret", "api_key", "apikey")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_DIGITS = frozenset("0123456789")
_PHONE = frozenset(" ().-0123456789")
_URL = re.compile(r"[^\s<>\"'`|\\^{}]+")
_AFTER_CUE = re.compile(r"[ \t]*(?:no\.?|number|id)?[ \t]*[:=#]?[ \t]*[\"']?", re.IGNORECASE | re.ASCII)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", re.IGNORECASE | re.ASCII)
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9])")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])")
_SECRET = re.compile(r"[A-Za-z0-9_\-]{20,}")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _email(text: str, at: int, free: int) -> tuple[int, int] | None:
    left = at
    while left > free and text[left - 1] in _LOCAL:
        left -= 1
    if left == at:
        return None
    n, stop, dots = len(text), at + 1, 0
    while stop < n and text[stop] in _LABEL:
        stop += 1
    if stop == at + 1:
        return None
    while stop + 1 < n and text[stop] == "." and text[stop + 1] in _LABEL:
        stop += 2
        dots += 1
        while stop < n and text[stop] in _LABEL:
            stop += 1
    return (left, stop) if dots else None


def _addresses(text: str, at: int, spans: list[Span]) -> int:
    """Adds the addresses of the run of dotted numbers at ``at``; its end."""
    n, edges, stop = len(text), [], at
    while True:
        begin = stop
        while stop < n and text[stop] in _DIGITS:
            stop += 1
        edges.append((begin, stop))
        if stop + 1 < n and text[stop] == "." and text[stop + 1] in _DIGITS:
            stop += 1
        else:
            break
    for k in range(0, len(edges) - 3, 4):
        own = edges[k : k + 4]
        if all(len(text[a:b].lstrip("0")) <= 3 and int(text[a:b].lstrip("0") or "0") <= 255 for a, b in own):
            spans.append(("ip", own[0][0], own[3][1]))
    return stop


def _card(text: str, at: int, spans: list[Span]) -> int:
    n, stop, digits = len(text), at + 1, [text[at]]
    while stop < n:
        if text[stop] in _DIGITS:
            digits.append(text[stop])
            stop += 1
        elif text[stop] in " -" and stop + 1 < n and text[stop + 1] in _DIGITS:
            digits.append(text[stop + 1])
            stop += 2
        else:
            break
    if 12 <= len(digits) <= 19 and luhn("".join(digits)):
        spans.append(("card", at, stop))
    return stop


def _phone(text: str, at: int, spans: list[Span]) -> None:
    n, stop = len(text), at + 2
    if at + 1 >= n or text[at + 1] not in _DIGITS:
        return
    while stop < n and text[stop] in _PHONE:
        stop += 1
    while stop > at + 3 and text[stop - 1] not in _DIGITS:
        stop -= 1
    if stop > at + 3 and 9 <= sum(c in _DIGITS for c in text[at:stop]) <= 15:
        spans.append(("phone", at, stop))


def _url(text: str, at: int, spans: list[Span]) -> int:
    found = _URL.match(text, at)
    stop = found.end() if found else at
    while stop > at and text[stop - 1] in ".,;:!?)]*":
        stop -= 1
    host = re.split(r"[/?#]", text[at:stop].split("://", 1)[-1], maxsplit=1)[0].rsplit("@", 1)[-1].split(":")[0]
    if host and ("." in host.strip(".") or host == "localhost"):
        spans.append(("url", at, stop))
    return stop


def _iban(text: str) -> bool:
    compact = text.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _account(text: str, cue: str, after: int, spans: list[Span]) -> None:
    begin = _AFTER_CUE.match(text, after).end()
    if cue == "ssn":
        found = _SSN.match(text, begin)
    elif cue == "iban":
        found = _IBAN.match(text, begin)
        if found:
            # The longest prefix whose check digits hold: a word may follow without a break.
            for stop in range(found.end(), begin + 14, -1):
                if text[stop - 1] != " " and _iban(text[begin:stop]):
                    spans.append(("account", begin, stop))
                    break
        return
    else:
        found = _ACCOUNT.match(text, begin)
    if found:
        spans.append(("account", begin, found.end()))


def _secret(text: str, after: int, spans: list[Span]) -> int:
    found = _SECRET.match(text, _AFTER_CUE.match(text, after).end())
    if found and any(c in _DIGITS for c in found.group()):
        spans.append(("secret", found.start(), found.end()))
    return found.end() if found else after


_automaton = None


def anchors():
    """The automaton of all anchors, built once in each worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        found = ahocorasick.Automaton()
        for c in "@+0123456789":
            found.add_word(c, (c if c in "@+" else "digit", 1))
        for kind, cues in (("url", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
            for cue in cues:
                # Cues and schemes in any mix of capitals; only ASCII letters fold.
                for form in product(*({c, c.upper()} for c in cue)):
                    found.add_word("".join(form), (kind, len(cue)))
        found.make_automaton()
        _automaton = found
    return _automaton


def find_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points, by start and then kind in the order of KINDS."""
    spans: list[Span] = []
    email_free = address_free = card_free = url_free = secret_free = 0
    for last, (kind, size) in anchors().iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= address_free:
                address_free = _addresses(text, at, spans)
            if at >= card_free:
                card_free = _card(text, at, spans)
        elif kind == "@":
            found = _email(text, at, email_free)
            if found:
                spans.append(("email", *found))
                email_free = found[1]
        elif kind == "+":
            _phone(text, at, spans)
        elif kind == "url":
            if at >= url_free:
                url_free = _url(text, at, spans)
        elif kind == "account":
            _account(text, text[at : last + 1].lower(), last + 1, spans)
        elif at >= secret_free:
            secret_free = _secret(text, last + 1, spans)
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(spans), key=lambda s: (s[1], order[s[0]], s[2]))


def written_out(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with each run of overlapping spans replaced by the first one's kind in brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind, start, end) of every row of ``docs`` (doc_id, text).

    Null and empty texts have no spans. Rows that repeat and null doc_ids get rows of their own; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(text.as_py() or "")] for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 (hash of the base spans written out) and spans (all, written out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in BASE}
            shas, alls = [], []
            for text in batch.column("text"):
                spans = find_spans(text.as_py() or "")
                base = [s for s in spans if s[0] in BASE]
                for k in BASE:
                    counts[k].append(sum(s[0] == k for s in base))
                shas.append(hashlib.sha256(written_out(base).encode()).hexdigest())
                alls.append(written_out(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(shas, pa.string()), pa.array(alls, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by the kind in brackets; null stays null, all columns and rows stay."""
    names, schema = docs.columns, StructType([StructField("text", StringType()) if f.name == "text" else f for f in docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value in batch.column("text"):
                text = value.as_py()
                texts.append(redacted(text, find_spans(text)) if text else text)
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)
