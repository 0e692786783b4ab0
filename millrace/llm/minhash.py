"""Near-duplicate documents by circulant MinHash, banding and exact verification.

Two permutations serve all signature coordinates. Both act on the integers below
2**32: the first, sigma, scatters the shingle hashes; the second, pi, is
shifted circularly by k places for coordinate k, so h_k = min over the set of
pi((sigma(x) + k) mod 2**32).

The plan:

1. One scan computes, for each document, the number of distinct shingles, a
   fingerprint of the set and the band keys of its signature. Documents with
   equal sets form a class with the smallest doc_id as its representative; only
   representatives go on, so copies cost one aggregation.
2. Representatives meet in buckets (band number, band hash). Buckets of one go,
   and of buckets with the same members one stays.
3. The texts of those members alone are read again and turned to shingle sets.
   Every member is compared with the least one of its bucket. Verified links
   are contracted to components: a family of near copies, however large, mostly
   becomes one here, at one comparison for each member.
4. What is left are buckets of three and more whose members lie in different
   components. They are dealt into blocks of bounded size, a large component
   into blocks of its own, and two blocks meet unless both are of the same
   component. A pair of blocks counts all intersections at once as a product of
   0/1 matrices over the shingles that they share.
5. The components of all verified links are the result.

Every pair that shares a bucket is thus compared on whole sets, unless its two
members are known to be connected. Loss: a pair at similarity s shares no band
with probability (1 - s**rows)**bands: 8e-7 at 0.85 and 7e-5 at 0.80 with the
defaults.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.shared import id_and_text, join_counted, removed, written
from millrace.llm.shingles import mix64, shingle_sets, text_slices

BANDS, ROWS, WIDTH = 24, 5, 5
#: Documents in one block, and shingles of all of them.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 500_000
#: What names a group of rows that one comparison takes: a bucket and two of its blocks, or a least member and a part of the others.
GROUP = ("bucket", "lo", "hi")
_EMPTY = 0xFFFFFFFF
_SLICE = 1 << 16
#: Bits of the bitmap of documents whose sets are wanted: 8 MB.
SLOTS = 1 << 26
#: Columns of the 0/1 matrices at a time.
_COLUMNS = 4096


def _sigma(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


_STEP = 0x9E3779B1


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row of ``coordinates`` minima per set; an empty set has the largest value everywhere."""
    out = np.full((len(sets), coordinates), _EMPTY, dtype=np.uint32)
    filled = [i for i, s in enumerate(sets) if len(s)]
    first = 0
    while first < len(filled):
        last, size = first, 0
        while last < len(filled) and (last == first or size + len(sets[filled[last]]) <= _SLICE):
            size += len(sets[filled[last]])
            last += 1
        rows = filled[first:last]
        flat = np.concatenate([sets[i] for i in rows])
        at = np.cumsum([0] + [len(sets[i]) for i in rows[:-1]])
        # pi starts with a product, and (y + k) * c = y * c + k * c: a shift costs one addition.
        start = _sigma((flat >> np.uint64(32)).astype(np.uint32)) * np.uint32(_STEP)
        for k in range(coordinates):
            z = start + np.uint32(k * _STEP & 0xFFFFFFFF)
            z ^= z >> np.uint32(15)
            z *= np.uint32(0xC2B2AE35)
            z ^= z >> np.uint32(13)
            z *= np.uint32(0x27D4EB2F)
            z ^= z >> np.uint32(16)
            out[rows, k] = np.minimum.reduceat(z, at)
        first = last
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents x bands) 64-bit keys; the band's number is part of its key."""
    keys = np.empty((len(sig), bands), dtype=np.uint64)
    for j in range(bands):
        key = np.full(len(sig), j + 1, dtype=np.uint64)
        for i in range(rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, j * rows + i])
        keys[:, j] = key
    return keys.view(np.int64)


def set_marks(sets: list[np.ndarray]) -> np.ndarray:
    """(sets x 3) 64-bit sums over mixed members: equal for equal sets, and in practice for those alone."""
    out = np.zeros((len(sets), 3), dtype="<u8")
    filled = [i for i, s in enumerate(sets) if len(s)]
    if filled:
        flat = np.concatenate([sets[i] for i in filled])
        at = np.cumsum([0] + [len(sets[i]) for i in filled[:-1]])
        for lane, salt in enumerate((0x1234567, 0x7654321, 0x5A5A5A5)):
            out[filled, lane] = np.add.reduceat(mix64(flat ^ np.uint64(salt)), at)
    return out


def _describe(batches: Iterator[pa.RecordBatch], bands: int, rows: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for first, end, raw, offsets in text_slices(batch.column("text")):
            sets = shingle_sets(raw, offsets, width)
            keys, marks = band_keys(signatures(sets, bands * rows), bands, rows), set_marks(sets)
            # A text without shingles has no bands.
            filled = np.array([len(s) > 0 for s in sets])
            ends = np.append(0, np.cumsum(filled * bands)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, end - first),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([m.tobytes() for m in marks], pa.binary()),
                    pa.array(marks[:, 0].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[filled].ravel())),
                ],
                names=["doc_id", "n_shingles", "mark", "cls", "bands"],
            )


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables of one (bucket, lo, hi) group each; a group has two blocks at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(c).to_numpy() for c in GROUP])
        change = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
        if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in GROUP):
            yield pa.Table.from_batches(held)
            held = []
        for begin, end in zip([0, *change], [*change, batch.num_rows]):
            held.append(batch.slice(begin, end - begin))
            if end < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype="<u8") for x in column]


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _linked_to_first(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of the first row of each group, which has block 0, to the others, on whole sets."""
    for group in _grouped(batches):
        ids, sets = group.column("doc_id").to_numpy(), _sets(group.column("shingles"))
        first, others = sets[0], sets[1:]
        if not others:
            continue
        flat, size = np.concatenate(others), np.array([len(s) for s in others])
        at = np.searchsorted(first, flat)
        at[at == len(first)] = 0
        shared = np.add.reduceat((first[at] == flat).astype(np.int64), np.cumsum(size) - size)
        good = 100 * shared >= percent * (len(first) + size - shared)
        yield _edges(np.full(int(good.sum()), ids[0]), ids[1:][good])


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right``; members are distinct within a set."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    (one, one_of), (two, two_of) = ((np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (left, right))
    # Only members that stand on both sides count.
    both = np.intersect1d(one, two)
    if not len(both):
        return out
    places = []
    for flat, of in ((one, one_of), (two, two_of)):
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        held = both[at] == flat
        places.append((at[held], of[held]))
    for begin in range(0, len(both), _COLUMNS):
        width = min(_COLUMNS, len(both) - begin)
        parts = []
        for (at, of), n in zip(places, (len(left), len(right))):
            part = np.zeros((n, width), dtype=np.float32)
            own = (at >= begin) & (at < begin + width)
            part[of[own], at[own] - begin] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _linked_in_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Each row of a group with the least row of those it is connected to over links between the group's two blocks."""
    for group in _grouped(batches):
        ids, block, sets = group.column("doc_id").to_numpy(), group.column("block").to_numpy(), _sets(group.column("shingles"))
        n = np.array([len(s) for s in sets])
        lo = block == group.column("lo")[0].as_py()
        left = np.flatnonzero(lo)
        right = left if lo.all() else np.flatnonzero(~lo)
        if not len(left) or not len(right):
            continue
        shared = intersections([sets[i] for i in left], [sets[i] for i in right]).astype(np.int64)
        linked = 100 * shared >= percent * (n[left][:, None] + n[right][None, :] - shared)
        least = np.arange(len(ids))
        while True:
            a, b = least[left], least[right]
            a = np.minimum(a, np.where(linked, b[None, :], len(ids)).min(axis=1))
            b = np.minimum(b, np.where(linked, a[:, None], len(ids)).min(axis=0))
            now = least.copy()
            np.minimum.at(now, left, a)
            np.minimum.at(now, right, b)
            if (now == least).all():
                break
            least = now
        moved = np.flatnonzero(least != np.arange(len(ids)))
        yield _edges(ids[least[moved]], ids[moved])


def _slot() -> F.Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))


def _slots_of(ids: DataFrame) -> np.ndarray:
    """One bit for each hash slot that a doc_id of ``ids`` falls into."""
    words_ = ids.groupBy(F.shiftright(_slot(), 6).alias("i")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(xxhash64(doc_id), {SLOTS}L) & 63 AS INT)))").alias("bits"))
    found = words_.toArrow()
    out = np.zeros(SLOTS >> 6, dtype=np.uint64)
    out[found.column("i").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _shingle_rows(batches: Iterator[pa.RecordBatch], width: int, bits) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot = batch.column("slot").to_numpy().astype(np.uint64)
        held = (bits.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
        batch = batch.filter(pa.array(held))
        for first, end, raw, offsets in text_slices(batch.column("text")):
            sets = shingle_sets(raw, offsets, width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, end - first), pa.array(set_marks(sets)[:, 0].view(np.int64)), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())],
                names=["doc_id", "cls", "shingles"],
            )


def _blocks(rows: F.Column, shingles: F.Column) -> F.Column:
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _part(blocks: F.Column) -> F.Column:
    return F.pmod(F.xxhash64("doc_id", "cls"), blocks).cast("int")


def _buckets(reps: DataFrame) -> DataFrame:
    """(bucket, members, doc_id, cls, n_shingles, least): members of buckets of two and more; of buckets with the same members one.

    ``least`` is the representative of least doc_id in the bucket, as a struct of what names it.
    """
    members = reps.select(F.explode("bands").alias("bucket"), "doc_id", "cls", "n_shingles")
    own = F.struct("doc_id", "cls", "n_shingles")
    sizes = members.groupBy("bucket").agg(
        F.count("*").alias("members"), F.min(own).alias("least"), *[F.bit_xor(F.xxhash64(F.lit(k), "doc_id", "cls")).alias(f"m{k}") for k in (1, 2)]
    )
    # Equal members: equal numbers and two sums of 64 bits.
    sizes = sizes.filter("members > 1").groupBy("members", "m1", "m2", "least").agg(F.min("bucket").alias("bucket")).select("bucket", "members", "least")
    sizes = written(sizes, "bucket-sizes")
    out = written(join_counted(members, sizes, ["bucket"], "members"), "buckets")
    removed(sizes)
    return out


def _first_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links of the members of buckets to the least one there."""
    pairs = members.filter(~((F.col("doc_id") == F.col("least.doc_id")) & (F.col("cls") == F.col("least.cls"))))
    pairs = pairs.select("least", "doc_id", "cls", "n_shingles").distinct().filter(100 * F.least("n_shingles", "least.n_shingles") >= percent * F.greatest("n_shingles", "least.n_shingles"))
    pairs = written(pairs, "first-pairs")
    parts = pairs.groupBy("least").agg(_blocks(F.count("*"), F.sum("n_shingles")).alias("hi"), F.count("*").alias("members"))
    others = join_counted(pairs, parts, ["least"], "members").select("least", _part(F.col("hi")).alias("hi"), F.lit(1).alias("block"), "doc_id", "cls")
    firsts = parts.select("least", F.explode(F.sequence(F.lit(0), F.col("hi") - 1)).alias("hi"), F.lit(0).alias("block"), F.col("least.doc_id").alias("doc_id"), F.col("least.cls").alias("cls"))
    rows = firsts.unionByName(others).select(F.col("least.doc_id").alias("bucket"), F.col("least.cls").alias("lo"), F.col("hi").cast("long").alias("hi"), "block", "doc_id", "cls")
    return rows.join(sets, ["doc_id", "cls"]).repartition(*GROUP).sortWithinPartitions(*GROUP, "block").mapInArrow(lambda it: _linked_to_first(it, percent), "a long, b long")


def _other_links(members: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Verified links within buckets of three and more between members that ``found`` (node, component) leaves in different components."""
    crowd = members.filter("members > 2").select("bucket", "members", "doc_id", "cls", "n_shingles")
    named = crowd.join(found, crowd["doc_id"] == found["node"], "left").select("bucket", "doc_id", "cls", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    named = written(named, "named")
    parts = named.groupBy("bucket", "component").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("size"))
    parts = parts.withColumn("own", _blocks(F.col("rows"), F.col("size"))).withColumn("large", F.col("own") > 1)
    # Small components share mixed blocks, which come first; each large one has blocks of its own.
    small = F.when(~F.col("large"), F.col("rows")), F.when(~F.col("large"), F.col("size"))
    totals = parts.groupBy("bucket").agg(
        F.count("*").alias("components"), F.sum("rows").alias("members"), F.coalesce(_blocks(F.sum(small[0]), F.sum(small[1])), F.lit(0)).alias("mixed"), F.coalesce(F.sum(F.when(F.col("large"), F.col("own"))), F.lit(0)).alias("pure")
    )
    totals = totals.filter("components > 1").select("bucket", "members", "mixed", (F.col("mixed") + F.col("pure")).cast("int").alias("blocks"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy("bucket").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    large = parts.filter("large").withColumn("before", before.cast("int")).select("bucket", "component", "rows", "own", "before")
    placed = join_counted(named, large, ["bucket", "component"], "rows", "left")
    placed = join_counted(placed, totals, ["bucket"], "members")
    block = F.when(F.col("own").isNull(), _part(F.greatest("mixed", F.lit(1)))).otherwise(F.col("mixed") + F.col("before") + _part(F.col("own")))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    mine = F.col("mixed") + F.col("before")
    others = F.when(F.col("own").isNull(), others).otherwise(F.filter(others, lambda o: (o < mine) | (o >= mine + F.col("own"))))
    rows = placed.withColumn("block", block).withColumn("other", F.explode(others)).select(
        "bucket", F.least("block", "other").cast("long").alias("lo"), F.greatest("block", "other").cast("long").alias("hi"), "block", "doc_id", "cls"
    )
    return rows.join(sets, ["doc_id", "cls"]).repartition(*GROUP).sortWithinPartitions(*GROUP, "block").mapInArrow(lambda it: _linked_in_blocks(it, percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Class of near-duplicates of every row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| over their
    sets of distinct ``width``-word shingles, words being runs of anything but
    ASCII white space with A-Z lower-cased; a text of fewer words has one
    shingle of all of them. ``component_id`` is the least doc_id reachable over
    links, ``kept`` is doc_id = component_id.

    Null and empty texts and texts of white space have no shingles, are linked
    with nothing and kept. Rows with one doc_id are one node: each gets a row of
    its own with the shared component. A row without doc_id takes the component
    of the documents with its set, or null, and is kept only if that is null.
    Other columns are ignored. An empty table gives an empty result.
    """
    source = id_and_text(docs)
    described = written(
        source.mapInArrow(lambda it: _describe(it, bands, rows, width), "doc_id long, n_shingles long, mark binary, cls long, bands array<long>"), "described"
    )
    classes = described.filter("n_shingles > 0").groupBy("mark", "n_shingles", "cls").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.count("*").alias("rows"))
    reps = written(classes.filter("doc_id is not null"), "representatives")
    members = _buckets(reps)
    # Texts are passed by a bitmap of fixed size, so none moves; sets that pass by chance are dropped by the joins.
    bits = docs.sparkSession.sparkContext.broadcast(_slots_of(members))
    shingled = source.filter("doc_id is not null").withColumn("slot", _slot()).mapInArrow(lambda it: _shingle_rows(it, width, bits), "doc_id long, cls long, shingles binary")
    sets = written(shingled.dropDuplicates(["doc_id", "cls"]), "sets")
    first = components(_first_links(members, sets, percent))
    other = _other_links(members, sets, first, percent)
    # Links between components of the first ones; each end is named by its component.
    for end in ("a", "b"):
        other = other.join(first, other[end] == first["node"], "left").withColumn(end, F.coalesce("component", end)).select("a", "b")
    second = components(other)
    removed(members, sets)
    found = first.join(second.select(F.col("node").alias("component"), F.col("component").alias("last")), "component", "left")
    found = found.select("node", F.coalesce("last", "component").alias("component")).unionByName(second.join(first.select("node"), "node", "left_anti"))
    named = reps.join(found, reps["doc_id"] == found["node"], "left").select("mark", "n_shingles", F.coalesce("component", "doc_id").alias("component"), "rows")
    out = join_counted(described.filter("n_shingles > 0").select("doc_id", "mark", "n_shingles"), named, ["mark", "n_shingles"], "rows", "left")
    # Texts without shingles meet nothing.
    alone = described.filter("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component"))
    return (
        out.select("doc_id", "n_shingles", "component").unionByName(alone)
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    )
