"""Packing tokenised documents into fixed-length sequences by vector bin packing.

Every document piece demands three things of a sequence: tokens, one segment
and loss-bearing tokens. A sequence has a limit on each. Within a task, whole
sequences are cut off long documents first; the remainders wait in a pool of
bounded size, and each new sequence takes, again and again, the piece whose
demand has the largest dot product with what the sequence has left, both
scaled by the limits. When no piece fits and tokens are left, the best piece
is cut to fill them exactly. What cannot fill a sequence (the end of a task's
pool, or a sequence that ran out of segments) is cut at powers of two, lengths
that need no padding.

Tasks pack on their own: no shuffle, no shared counter, and hot sources make no
hot task. ``sequence_id`` holds the task's partition in its upper bits, so a
task that is run again gives the same rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens and pieces that wait in a task's pool at most before a round of packing.
POOL_TOKENS, POOL_PIECES = 1 << 19, 1 << 15
#: Blanks in a run from which the library of the vocabulary's other file encodes a text: the pattern's look-ahead needs stack for each.
_LONG_BLANKS = re.compile(r"\s{20000}")
_PARTITION_SHIFT = 38

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


@dataclass
class Piece:
    """A run of one document's ids; ``loss`` counts the loss-bearing ones before each place of the document."""

    doc: int | None
    ids: np.ndarray
    loss: np.ndarray
    start: int
    length: int

    @property
    def loss_tokens(self) -> int:
        return int(self.loss[self.start + self.length] - self.loss[self.start])

    def cut(self, length: int) -> tuple[Piece, Piece | None]:
        rest = Piece(self.doc, self.ids, self.loss, self.start + length, self.length - length)
        return Piece(self.doc, self.ids, self.loss, self.start, length), rest if rest.length else None


class Packer:
    """Packs pieces into sequences, each a list of pieces within the limits.

    Pieces of one demand are alike, so the pool keeps a list of pieces for each distinct demand and a
    placement looks at the demands alone: a million one-token pieces are one demand.
    """

    def __init__(self, limits: Limits):
        self.limits = limits
        self.pool: dict[tuple[int, int], list[Piece]] = {}
        self.waiting = self.pieces = 0

    def _put(self, piece: Piece) -> None:
        self.pool.setdefault((piece.length, piece.loss_tokens), []).append(piece)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Sequences that are full by now."""
        rest: Piece | None = piece
        while rest is not None and rest.length >= self.limits.tokens:
            whole, left = rest.cut(self.limits.tokens)
            if whole.loss_tokens > self.limits.loss:
                break
            yield [whole]
            rest = left
        if rest is not None:
            self._put(rest)
            self.waiting += rest.length
            self.pieces += 1
            if self.waiting >= POOL_TOKENS or self.pieces >= POOL_PIECES:
                yield from self._pack(last=False)

    def finish(self) -> Iterator[list[Piece]]:
        yield from self._pack(last=True)

    def _fitting(self, piece: Piece, tokens: int, loss: int) -> int:
        """The longest prefix of ``piece`` within what is left."""
        most = min(piece.length, tokens)
        within = np.searchsorted(piece.loss[piece.start : piece.start + most + 1], piece.loss[piece.start] + loss, side="right") - 1
        return int(min(most, within))

    def _pack(self, last: bool) -> Iterator[list[Piece]]:
        limits = self.limits
        scale = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
        need = np.array([(n, 1, loss) for n, loss in self.pool], dtype=np.float64).reshape(-1, 3)
        lists = list(self.pool.values())
        total = int(sum(need[k, 0] * len(own) for k, own in enumerate(lists)))
        while total >= limits.tokens or last and total > 0:
            left = scale.copy()
            bin_: list[Piece] = []
            while left[0] > 0 and left[1] > 0 and len(lists):
                fits = (need <= left).all(axis=1)
                worth = need @ (left / scale**2)
                if fits.any():
                    k = int(np.argmax(np.where(fits, worth, -1.0)))
                    # Of a demand that stands alone all that fit are taken at once.
                    times = 1 if len(lists) > 1 else min(len(lists[k]), *(int(a // b) for a, b in zip(left, need[k]) if b))
                    bin_ += lists[k][-times:]
                    del lists[k][-times:]
                    left -= times * need[k]
                    total -= times * int(need[k, 0])
                    rest = None
                else:
                    k = int(np.argmax(worth))
                    size = self._fitting(lists[k][-1], int(left[0]), int(left[2]))
                    if not size:
                        break
                    taken, rest = lists[k].pop().cut(size)
                    bin_.append(taken)
                    left -= (taken.length, 1, taken.loss_tokens)
                    total -= taken.length
                if not lists[k]:
                    lists.pop(k)
                    need = np.delete(need, k, axis=0)
                if rest is not None:
                    demand = (rest.length, 1, rest.loss_tokens)
                    same = np.flatnonzero((need == demand).all(axis=1))
                    if len(same):
                        lists[int(same[0])].append(rest)
                    else:
                        lists.append([rest])
                        need = np.vstack([need, demand])
            if not bin_:
                raise ValueError("limits leave no room for a single token")
            yield from powers_of_two(bin_, limits)
        self.pool = {(own[0].length, own[0].loss_tokens): own for own in lists}
        self.waiting, self.pieces = total, sum(map(len, lists))


def powers_of_two(pieces: list[Piece], limits: Limits) -> Iterator[list[Piece]]:
    """The pieces as one sequence if it is full, else as sequences whose lengths are powers of two."""
    total = sum(p.length for p in pieces)
    if total == limits.tokens:
        yield pieces
        return
    queue = list(reversed(pieces))
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        own = []
        while size:
            piece = queue.pop()
            taken, rest = piece.cut(min(size, piece.length))
            if rest is not None:
                queue.append(rest)
            own.append(taken)
            size -= taken.length
        yield own


_encoders: dict[tuple, object] = {}


def encoder(ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...]):
    """A tokenizer kept for the life of the worker; special strings in a text become their ids."""
    key = (ranks_path, pattern, special)
    if key not in _encoders:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[key] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
    return _encoders[key]


_libraries: dict[str, object] = {}


def library(path: str):
    """The same vocabulary in the form that has no limit on runs of blanks; slower, and kept for the life of the worker."""
    if path not in _libraries:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        _libraries[path] = own
    return _libraries[path]


@dataclass(frozen=True)
class Tokens:
    """How texts become ids: files of one byte-level vocabulary and how it splits texts."""

    ranks_path: str
    pattern: str
    special: tuple[tuple[str, int], ...]
    library_path: str | None

    def ids(self, text: str) -> np.ndarray:
        if self.library_path and _LONG_BLANKS.search(text):
            return np.array(library(self.library_path).encode(text, add_special_tokens=False).ids, dtype="<u4")
        return encoder(self.ranks_path, self.pattern, self.special).encode_to_numpy(text, allowed_special={s for s, _ in self.special}, disallowed_special=())

    def first_after(self, ids: np.ndarray, text: str, place: int) -> int:
        """How many of ``ids`` begin before code point ``place`` of ``text``."""
        own, special = encoder(self.ranks_path, self.pattern, self.special), {i: len(s.encode()) for s, i in self.special}
        size = [special[i] if i in special else len(own.decode_single_token_bytes(i)) for i in ids.tolist()]
        begins = np.cumsum([0, *size])[:-1] if size else np.zeros(0, np.int64)
        return int(np.searchsorted(begins, len(text[: max(place, 0)].encode())))


def _rows(batches: Iterator[pa.RecordBatch], tokens: Tokens, end_id: int, limits: Limits) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << _PARTITION_SHIFT
    packer, ready = Packer(limits), []

    def collect(sequences: Iterator[list[Piece]]) -> None:
        nonlocal number
        for pieces in sequences:
            offset = 0
            for p in pieces:
                ids = p.ids[p.start : p.start + p.length]
                ready.append((p.doc, p.start, p.length, zlib.crc32(ids.tobytes()), len(p.ids), number, offset, p.loss_tokens))
                offset += p.length
            number += 1

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*ready)], names=[f.split()[0] for f in SCHEMA.split(", ")])
        ready.clear()
        return batch

    # The end id alone: what every empty text is.
    nothing, no_loss = np.array([end_id], dtype="<u4"), np.zeros(2, dtype=np.int64)
    for batch in batches:
        for doc, text, answer in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("answer_from").to_pylist()):
            whole = text.as_py() or ""
            if not whole:
                collect(packer.add(Piece(doc, nothing, no_loss, 0, 1)))
                continue
            own = np.append(tokens.ids(whole), end_id).astype("<u4")
            # A document's first token has nothing before it to be predicted from, and a prompt is given.
            given = 1 if answer is None else max(1, tokens.first_after(own[:-1], whole, answer))
            loss = np.maximum(np.arange(len(own) + 1) - given, 0)
            collect(packer.add(Piece(doc, own, loss, 0, len(own))))
            if len(ready) > 20_000:
                yield flush()
        if len(ready) > 20_000:
            yield flush()
    collect(packer.finish())
    if ready:
        yield flush()


def pack_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    special: dict[str, int] | None = None,
    end_id: int = 1,
    limits: Limits = Limits(),
    library_path: str | None = None,
    answer_from: str | None = None,
) -> DataFrame:
    """Pieces of the tokenised texts of ``docs`` (doc_id, text), one row each, columns as in ``SCHEMA``.

    A document is its text's ids and then ``end_id``. Each id lies in exactly one piece; pieces of a
    sequence lie gapless from offset 0. A sequence has ``limits.tokens`` tokens or a power of two, so
    nothing is padded. Null and empty texts are the end id alone. Rows that repeat are packed again;
    a null doc_id stays null. Other columns are ignored; an empty table gives an empty result.

    ``answer_from`` names a column with the code point from which a text bears loss: what begins
    before it is a prompt. Where it is null, and without such a column, all ids but a document's first
    bear loss. ``library_path`` is the same vocabulary for the tokenizers library, which encodes texts
    with runs of 20,000 blanks and more; without it a run of about a million fails. Both paths must be
    readable on every executor.
    """
    tokens = Tokens(ranks_path, pattern, tuple(sorted((special or {}).items())), library_path)
    answer = F.col(answer_from).cast("int") if answer_from else F.lit(None).cast("int")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), answer.alias("answer_from"))
    return own.mapInArrow(lambda batches: _rows(batches, tokens, end_id, limits), SCHEMA)
