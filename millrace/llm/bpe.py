"""BPE encoding and decoding with a transducer lexicon of frequent words.

The vocabulary splits a text into pre-tokens that never cross white space and
merges each alone. Frequent pre-tokens of the corpus, counted over all of it,
are merged once and compiled into a minimal acyclic transducer: states with
equal futures are shared, and outputs on the arcs add up to a word's place in
a list of id sequences. The transducer is a handful of sorted arrays in one
file that Spark hands to executors and workers memory-map; many words walk it together. A word that it does
not hold is merged exactly, by lowest rank first.

In a batch of texts every distinct white-space token is encoded once, and ids
and token strings are gathered per text by Arrow, so common words cost no
Python call each.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import id_and_text, removed, written, written_bytes
from millrace.llm.shingles import LOWER, byte_class, text_slices, word_hashes, words

#: Letter runs in the lexicon at most, and bytes of one: what reaches the driver and is sent to workers is bounded.
LEXICON_WORDS, LEXICON_BYTES = 1 << 16, 64
#: White-space tokens in each of the two generations whose encoding a worker remembers.
_REMEMBERED = 120_000
_SLICE_BYTES = 4 << 20
#: Bytes from which a word is merged alone, by a heap.
_LONG = 64
#: Text that a task holds while it counts words.
_HELD_BYTES = 1 << 24
_LETTERS = byte_class(bytes([*range(97, 123), *range(128, 256)]))


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


_FAR = re.compile("[\U00010000-\U0010ffff]")


def _any_of(points: list[int]) -> re.Pattern[str]:
    """Any of some code points, which ascend."""
    ends = [c for c, after in zip(points, [*points[1:], -1]) if after != c + 1]
    begins = [c for before, c in zip([-2, *points[:-1]], points) if c != before + 1]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(begins, ends)) + "]")


def doubtful(normalize) -> Callable[[str], bool]:
    """Whether a text holds code points on which the vocabulary's library, whose Unicode is of another year, may differ from ours.

    These are all to which our tables give no category, and the marks that ``normalize`` orders
    otherwise when a mark of some class stands before or after them.
    """
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    classes = {unicodedata.combining(m): m for m in reversed(marks)}.values()
    asked = " ".join(f"a{m}{other} a{other}{m}" for m in marks for other in classes)
    differ = [two[1:] for two, ours, theirs in zip(asked.split(" "), unicodedata.normalize("NFC", asked).split(" "), normalize(asked).split(" ")) if ours != theirs]
    times = Counter("".join(differ))
    # A mark that differs does so beside most classes; one that only stood beside it, a few times.
    odd = {ord(m) for m, n in times.items() if n > len(classes) // 4}
    found = [c for c in range(0x110000) if c in odd or unicodedata.category(chr(c)) == "Cn"]
    # In two classes: the first 65,536 code points are looked up in a table, the others one range after the other.
    near, far = (_any_of([c for c in found if (c < 0x10000) == low]) for low in (True, False))
    return lambda text: bool(near.search(text)) or bool(_FAR.search(text)) and bool(far.search(text))


class Vocabulary:
    """A word-ending BPE vocabulary: NFC, white space dropped, lower case, pre-tokens by pattern, bytes as letters."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.suffix = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}
        self.letters = byte_letters()
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.library = Tokenizer.from_file(path)
        self.doubtful = doubtful(self.library.normalizer.normalize_str)

        # The same as arrays: ids of single bytes (inside a word, at its end), merges by pair of ids.
        size = max(self.tokens) + 1
        self.single = np.array([self.ids[c] for c in self.letters])
        self.ending = np.array([self.ids[c + self.suffix] for c in self.letters])
        pairs = np.array([self.ids[a] * size + self.ids[b] for a, b in self.ranks])
        order = np.argsort(pairs)
        self.pair_keys, self.pair_ranks = pairs[order], order
        self.merged = np.array([self.ids[a + b] for a, b in self.ranks])
        self.size = size

    def _asked(self, piece: str) -> list[str]:
        """Pre-tokens by the tables of the vocabulary's own library, whose Unicode is another one than ours."""
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        return [bytes(self.byte_of[c] for c in word).decode() for word, _ in found]

    def pre_tokens(self, piece: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if not piece.isascii():
            if self.doubtful(piece):
                return self._asked(piece)
            # Lower case letter by letter: no final sigma.
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        return self.split.findall(piece.lower())

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Pre-tokens in order, and whether each is a special token."""
        at = 0
        if self.special is not None:
            for m in self.special.finditer(text):
                yield from ((w, False) for w in self.pre_tokens(text[at : m.start()]))
                yield m.group(), True
                at = m.end()
        yield from ((w, False) for w in self.pre_tokens(text[at:] if at else text))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], len(self.pair_ranks))

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word's begin (one place more than words).

        The pair of least rank merges first, the leftmost of equals. All words do a merge per round;
        a round ranks only the two pairs next to each merge anew, and words that are done leave.
        """
        lens, none = np.array([len(w) for w in words], dtype=np.int64), len(self.pair_ranks)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, word = self.single[raw], np.repeat(np.arange(len(words)), lens)
        last = np.cumsum(lens)[lens > 0] - 1
        sym[last] = self.ending[raw[last]]
        rank = np.full(len(sym), none)
        if len(sym) > 1:
            inner = np.flatnonzero(word[:-1] == word[1:])
            rank[inner] = self._rank(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(sym))))
            going = best < none
            if not going.all():
                done.append((word[~going], sym[~going]))
                sym, word, rank, best = sym[going], word[going], rank[going], best[going]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == best)
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
            sym[at] = self.merged[rank[at]]
            stay = np.ones(len(sym), dtype=bool)
            stay[at + 1] = False
            sym, word, rank = sym[stay], word[stay], rank[stay]
            at -= np.arange(len(at))
            for left in (at, at - 1):
                left = left[(left >= 0) & (left + 1 < len(sym))]
                pair = word[left] == word[left + 1]
                rank[left] = np.where(pair, self._rank(sym[left], sym[left + 1]), none)
            rank[-1] = none
        words_of, ids = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
        order = np.argsort(words_of, kind="stable")
        return ids[order].astype("<u4"), np.concatenate([[0], np.cumsum(np.bincount(words_of, minlength=len(words)))])

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token by a heap over a linked list, for words of any length."""
        import heapq

        parts = [self.letters[b] for b in word.encode()]
        parts[-1] += self.suffix
        n = len(parts)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, one, two = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or parts[i] != one or parts[j] != two:
                continue
            parts[i] = one + two
            alive[j] = False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (r := self.ranks.get((parts[a], parts[after[a]]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[after[a]]))
        return [self.ids[p] for p, a in zip(parts, alive) if a and p in self.ids]


class Lexicon:
    """A minimal acyclic transducer from words to id sequences, as arrays in one file.

    Arcs are sorted by (state, byte). ``target`` has the next state, ``gain`` what an arc adds to a
    word's place, ``final`` the states where a word ends. A word's ids are
    ``ids[start[place]:start[place + 1]]``.
    """

    _FIELDS = (("arc", "<i8"), ("target", "<i4"), ("gain", "<i4"), ("final", "u1"), ("start", "<i4"), ("ids", "<u4"))

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, words: Iterable[str], ids_of) -> Lexicon:
        """Compile distinct words, added in byte order; suffixes are shared as soon as a prefix is done."""
        ordered = sorted({w.encode() for w in words if w})
        # A state is [final, {byte: state}]; finished states are looked up by what follows them.
        root: list = [False, {}]
        finished: dict[tuple, list] = {}
        path, previous = [root], b""

        def finish(down_to: int) -> None:
            while len(path) - 1 > down_to:
                state = path.pop()
                key = (state[0], tuple((b, id(t)) for b, t in state[1].items()))
                path[-1][1][previous[len(path) - 1]] = finished.setdefault(key, state)

        for word in ordered:
            shared = 0
            while shared < min(len(word), len(previous)) and word[shared] == previous[shared]:
                shared += 1
            finish(shared)
            for b in word[shared:]:
                state = [False, {}]
                path[-1][1][b] = state
                path.append(state)
            path[-1][0] = True
            previous = word
        finish(0)
        # Words below each state, then arcs: an arc adds the words that sort before its own.
        number, queue, below = {id(root): 0}, [root], {}
        for state in queue:
            for t in state[1].values():
                if id(t) not in number:
                    number[id(t)] = len(queue)
                    queue.append(t)
        pending = [(root, False)]
        while pending:
            state, ready = pending.pop()
            if id(state) in below:
                continue
            if ready:
                below[id(state)] = state[0] + sum(below[id(t)] for t in state[1].values())
            else:
                pending.append((state, True))
                pending += [(t, False) for t in state[1].values() if id(t) not in below]
        arcs = []
        for state in queue:
            gain = int(state[0])
            for b, t in sorted(state[1].items()):
                arcs.append((number[id(state)] * 256 + b, number[id(t)], gain))
                gain += below[id(t)]
        arcs.sort()
        sequences = [ids_of(w.decode()) for w in ordered]
        return cls(
            {
                "arc": np.array([a[0] for a in arcs], "<i8"),
                "target": np.array([a[1] for a in arcs], "<i4"),
                "gain": np.array([a[2] for a in arcs], "<i4"),
                "final": np.array([s[0] for s in queue], "u1"),
                "start": np.cumsum([0, *map(len, sequences)]).astype("<i4"),
                "ids": np.array([i for s in sequences for i in s], "<u4"),
            }
        )

    def to_bytes(self) -> bytes:
        arrays = [getattr(self, name) for name, _ in self._FIELDS]
        return np.array([len(a) for a in arrays], "<i8").tobytes() + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)

    @classmethod
    def map_file(cls, path: str) -> Lexicon:
        sizes = np.fromfile(path, "<i8", len(cls._FIELDS))
        at, arrays = 8 * len(sizes), {}
        for (name, kind), n in zip(cls._FIELDS, sizes):
            nbytes = int(n) * np.dtype(kind).itemsize
            arrays[name] = np.memmap(path, kind, "r", at, int(n)) if n else np.zeros(0, kind)
            at += nbytes + -nbytes % 8
        return cls(arrays)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place, or -1; all words walk together, a byte at a time."""
        out = np.full(len(words), -1, dtype=np.int64)
        if not len(self.arc) or not words:
            return out
        size = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        who, state, place = np.flatnonzero(size), np.zeros(np.count_nonzero(size), np.int64), np.zeros(np.count_nonzero(size), np.int64)
        depth = 0
        while len(who):
            key = state * 256 + raw[first[who] + depth]
            k = np.searchsorted(self.arc, key)
            k[k == len(self.arc)] = 0
            on = self.arc[k] == key
            who, k = who[on], k[on]
            state, place = self.target[k].astype(np.int64), place[on] + self.gain[k]
            depth += 1
            done = size[who] == depth
            ends = done & (self.final[state] > 0)
            out[who[ends]] = place[ends]
            who, state, place = who[~done], state[~done], place[~done]
        return out


def _shipped(spark: SparkSession, content: bytes) -> str:
    """The name of a file with ``content`` in the shared folder, of which Spark hands a copy to every executor, also to one that joins later."""
    place = written_bytes(spark, content, "lexicon.bin")
    spark.sparkContext.addFile(place)
    return os.path.basename(place)


def _plain(token: str) -> list[str] | None:
    """Pre-tokens of an ASCII word with at most a stop or comma after it, which is most of them."""
    if token.isascii():
        if token.isalpha():
            return [token.lower()]
        if token[-1] in ".," and token[:-1].isalpha():
            return [token[:-1].lower(), token[-1]]
    return None


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


class Encoder:
    """Encodes white-space tokens through a lexicon, and remembers the latest ones."""

    def __init__(self, words: Vocabulary, lexicon: Lexicon):
        self.words, self.lexicon = words, lexicon
        self.known: dict[str, tuple[bytes, str]] = {"": (b"", "")}
        self.before: dict[str, tuple[bytes, str]] = {}
        self.strings = [""] * words.size
        for i, token in words.tokens.items():
            self.strings[i] = f" {token}"

    def _of_pre_tokens(self, words: list[str]) -> dict[str, tuple[bytes, str]]:
        raw, strings, out = [w.encode() for w in words], self.strings, {}
        places = self.lexicon.places(raw)
        held = np.flatnonzero(places >= 0)
        missing = [i for i in np.flatnonzero(places < 0).tolist() if len(raw[i]) <= _LONG]
        long = [i for i in np.flatnonzero(places < 0).tolist() if len(raw[i]) > _LONG]
        start = self.lexicon.start
        sources = [(held.tolist(), self.lexicon.ids, start[places[held]].tolist(), start[places[held] + 1].tolist())]
        ids, at = self.words.merge_many([raw[i] for i in missing])
        sources.append((missing, ids, at[:-1].tolist(), at[1:].tolist()))
        for i in long:
            own = np.array(self.words.merge(words[i]), "<u4")
            sources.append(([i], own, [0], [len(own)]))
        for who, ids, begin, end in sources:
            if who:
                flat, listed = ids.tobytes(), ids.tolist()
                for i, a, b in zip(who, begin, end):
                    out[words[i]] = flat[4 * a : 4 * b], "".join([strings[k] for k in listed[a:b]])
        return out

    def _with_special(self, token: str) -> tuple[bytes, str]:
        """A white-space token in which special strings stand: their ids between those of the rest."""
        parts = list(self.words.parts(token))
        own = self._of_pre_tokens(list({w for w, special in parts if not special}))
        found = [(np.array([self.words.added[w]], "<u4").tobytes(), f" {w}") if special else own[w] for w, special in parts]
        return b"".join(f[0] for f in found), "".join(f[1] for f in found)

    def learn(self, distinct: list[str]) -> None:
        if len(self.known) + len(distinct) > _REMEMBERED:
            self.before, self.known = self.known, {"": (b"", "")}
        known, before = self.known, self.before
        fresh = []
        for t in distinct:
            if t not in known:
                if t in before:
                    known[t] = before[t]
                else:
                    fresh.append(t)
        parts = [_plain(t) or self.words.pre_tokens(t) for t in fresh]
        own = self._of_pre_tokens(list({w for p in parts for w in p}))
        for token, p in zip(fresh, parts):
            if len(p) == 1:
                known[token] = own[p[0]]
            else:
                found = [own[w] for w in p]
                known[token] = b"".join([f[0] for f in found]), "".join([f[1] for f in found])
        if self.words.special is not None and self.words.special.search("\n".join(fresh)):
            for token in fresh:
                if self.words.special.search(token):
                    known[token] = self._with_special(token)

    def encode(self, texts: pa.Array) -> tuple[list, list]:
        """Per text the ids as little-endian bytes, and the tokens' strings joined by blanks."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self.learn(distinct)
        found = [self.known[t] for t in distinct]
        ids = pa.array([f[0] for f in found], pa.large_binary()).take(coded.indices)
        strings = pa.array([f[1] for f in found], pa.large_string()).take(coded.indices)
        offsets = lists.offsets
        offsets = pc.subtract(offsets, offsets[0])
        joined = [pc.binary_join(pa.LargeListArray.from_arrays(offsets.cast(pa.int64()), x), pa.scalar(empty, x.type)) for x, empty in ((ids, b""), (strings, ""))]
        return joined[0], [s.as_py()[1:] for s in joined[1]]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about _SLICE_BYTES of text, or of one text where that is longer."""
    column = batch.column("text")
    rows = max(1, _SLICE_BYTES * len(column) // max(column.nbytes, 1))
    for first in range(0, len(column), rows):
        texts = column.slice(first, rows).cast(pa.large_string())
        yield first, texts.fill_null("") if texts.null_count else texts


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of letters and of bytes outside ASCII, A-Z lower-cased, with how often each stands in a task's texts."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def counted() -> pa.RecordBatch:
        lens = [len(h[0]) for h in held]
        _, first, where = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
        n = np.bincount(where, np.concatenate([h[1] for h in held])).astype(np.int64)
        part = np.repeat(np.arange(len(held)), lens)[first]
        start, end = (np.concatenate([h[k] for h in held])[first].tolist() for k in (2, 3))
        texts = [h[4].tobytes() for h in held]
        words = [texts[p][a:b].decode("utf-8", "replace") for p, a, b in zip(part.tolist(), start, end)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n)], names=["word", "n"])

    for batch in batches:
        for _, _, raw, offsets in text_slices(batch.column("text")):
            low = LOWER[raw]
            start, end, _ = words(low, offsets, _LETTERS)
            if len(start):
                hashes, first, counts = np.unique(word_hashes(low, start, end), return_index=True, return_counts=True)
                held.append((hashes, counts, start[first], end[first], low))
                size += len(low)
            if size > _HELD_BYTES:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def frequent_words(docs: DataFrame, vocabulary_path: str, limit: int = LEXICON_WORDS) -> list[str]:
    """The pre-tokens in the most frequent letter runs of all texts, ``limit`` runs of ``LEXICON_BYTES`` bytes at most.

    Runs in the lexicon are those of the highest classes of counts, eight classes to a doubling, that
    hold at most ``limit`` together. Any other word is merged where it stands, to the same ids.
    """
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_word_counts, "word string, n long")
    counts = written(rows.groupBy("word").agg(F.sum("n").alias("n")).filter((F.col("n") > 1) & (F.octet_length("word") <= LEXICON_BYTES)), "word-counts")
    class_of = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    least, above = 1 << 30, 0
    for c, words in sorted(((r.c, r.words) for r in counts.groupBy(class_of.alias("c")).agg(F.count("*").alias("words")).collect()), reverse=True):
        above += words
        if above > limit:
            break
        least = c
    found = [r.word for r in counts.filter(class_of >= least).select("word").collect()]
    removed(counts)
    own = vocabulary(vocabulary_path)
    return sorted({w for f in found for w in own.pre_tokens(f)})


def encode(docs: DataFrame, vocabulary_path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) of every row of ``docs`` (doc_id, text).

    Ids are those of the whole text, special strings included as their ids; ``decoded`` joins the
    tokens' strings by blanks, as the vocabulary has no decoder of its own. Null and empty texts give
    no ids and an empty string. Rows that repeat and null doc_ids get rows of their own; other columns
    are ignored; an empty table gives an empty result. ``vocabulary_path`` must be readable on every
    executor.
    """
    return _encoded(docs, vocabulary_path, lexicon_words, "doc_id long, ids array<int>, decoded string", digests=False)


def digests(docs: DataFrame, vocabulary_path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (little-endian, 32 bits each) and of the decoded text; see ``encode``."""
    return _encoded(docs, vocabulary_path, lexicon_words, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests=True)


def _encoded(docs: DataFrame, vocabulary_path: str, lexicon_words: int, schema: str, digests: bool) -> DataFrame:
    words = vocabulary(vocabulary_path)
    lexicon = Lexicon.build(frequent_words(docs, vocabulary_path, lexicon_words), words.merge)
    name = _shipped(docs.sparkSession, lexicon.to_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(vocabulary(vocabulary_path), Lexicon.map_file(SparkFiles.get(name)))
            for first, texts in _texts(batch):
                ids, decoded = encoder.encode(texts)
                doc = batch.column("doc_id").slice(first, len(texts))
                if digests:
                    own = [
                        pa.array([len(i.as_buffer()) // 4 for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(i.as_buffer()).hexdigest() for i in ids]),
                        pa.array([hashlib.sha256(s.encode()).hexdigest() for s in decoded]),
                    ]
                    yield pa.RecordBatch.from_arrays([doc, *own], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    arrays = pa.array([np.frombuffer(i.as_buffer(), "<i4") for i in ids], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([doc, arrays, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return id_and_text(docs).mapInArrow(run, schema)
