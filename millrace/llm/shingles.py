"""Vectorised word and shingle hashing over Arrow string batches.

Texts stay as UTF-8 bytes in Arrow buffers; word boundaries, 64-bit word hashes
and shingle hashes are numpy array operations over a slice of whole texts, so
no Python code runs per word. A slice holds about ``SLICE_BYTES`` of text, or
one text where that is longer, so memory follows the longest text and never the
batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_LANES = _RNG.integers(1, 2**62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: Bytes A-Z to a-z; all others map to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def byte_class(pattern: bytes) -> np.ndarray:
    """Boolean table of 256 entries, true for the bytes in ``pattern``."""
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(pattern, dtype=np.uint8)] = True
    return table


#: Words are runs of anything but ASCII white space.
NOT_SPACE = ~byte_class(b" \t\n\x0b\x0c\r")
#: Words are runs of ASCII letters, digits and any byte outside ASCII.
WORD_BYTES = byte_class(bytes([*range(48, 58), *range(97, 123), *range(128, 256)]))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche on 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown when a longer text comes."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        factors[0] = 1
        have = _powers[base] = np.multiply.accumulate(factors)
    return have[:n]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole texts: (first row, end row, bytes, offsets).

    Offsets start at 0 and have one more entry than the run has rows; null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=8 * column.offset)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        end = min(end, n)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def words(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the words before each text (one more than texts)."""
    inside = is_word[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each word, equal wherever the word stands."""
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[raw] * _power(_BASE, len(raw)), out=total[1:])
    value = (total[end] - total[start]) * _power(_BASE_INV, len(raw) + 1)[start]
    return mix64(value + (end - start).astype(np.uint64) * _LANES[15])


def shingle_hashes(hashes: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words of one text, with repeats, and how many stand before each text.

    A text of fewer words gives one shingle of all of them; a text without words gives none.
    """
    n, counts = len(hashes), np.diff(before)
    texts = len(counts)
    if n >= width:
        run = np.zeros(n - width + 1, dtype=np.uint64)
        for i in range(width):
            run += hashes[i : n - width + 1 + i] * _LANES[i]
        text_of = np.repeat(np.arange(texts), counts)
        whole = text_of[: n - width + 1] == text_of[width - 1 :]
        run = mix64(run[whole])
    else:
        run = np.zeros(0, dtype=np.uint64)
    per_text = np.maximum(counts - width + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < width))
    at = np.concatenate([[0], np.cumsum(per_text)])
    if len(short):
        alone = np.empty(len(short), dtype=np.uint64)
        for k, i in enumerate(short):
            own = hashes[before[i] : before[i + 1]]
            alone[k] = np.sum(np.append(own * _LANES[: len(own)], _LANES[10 + len(own)]), dtype=np.uint64)
        run = np.insert(run, at[short], mix64(alone))
        per_text[short] = 1
        at = np.concatenate([[0], np.cumsum(per_text)])
    return run, at


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int, is_word: np.ndarray = NOT_SPACE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text, letters A-Z lower-cased."""
    low = LOWER[raw]
    start, end, before = words(low, offsets, is_word)
    run, at = shingle_hashes(word_hashes(low, start, end), before, width)
    out = []
    for i in range(len(at) - 1):
        own = np.sort(run[at[i] : at[i + 1]])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return out

