"""Exact deduplication through recipes of content-defined chunks.

A text is cut where a rolling hash of its last 32 bytes meets a mask, so equal
texts are cut alike and an edit moves only the cuts near it. Every distinct
chunk then crosses the network once: chunks are grouped by (digest, content),
and a digest that stands for two contents gets an ordinal, which makes its
identifiers verified rather than trusted. Documents are compared by their
ordered identifier lists, a few dozen bytes even for long texts; the texts
themselves move no further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import id_and_text, join_counted, written
from millrace.llm.shingles import text_slices

#: Smallest and largest chunk in bytes, and the mask whose bits make cuts about 4 KiB apart.
LEAST, MOST, MASK = 2048, 16384, (1 << 12) - 1
DIGEST_BYTES = 16

_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 2**32, 256, dtype=np.uint32)


def rolling(raw: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 bytes that end at each place: sum of gear(b[i - j]) << j, by doubling."""
    h = _GEAR[raw]
    for step in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        h = h + shifted
    return h


def cuts(raw: np.ndarray, least: int = LEAST, most: int = MOST, mask: int = MASK) -> list[int]:
    """Ends of the chunks of one text; none for an empty one."""
    n = len(raw)
    if n <= least:
        return [n] if n else []
    # High bits: the low ones hang on few bytes.
    marks = np.flatnonzero((rolling(raw) >> np.uint32(18) & np.uint32(mask)) == 0) + 1
    ends, at = [], 0
    while n - at > least:
        k = int(np.searchsorted(marks, at + least))
        end = min(int(marks[k]) if k < len(marks) else n, at + most, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def _digest(chunk: bytes, digest_bits: int) -> bytes:
    whole = hashlib.blake2b(chunk, digest_size=DIGEST_BYTES).digest()
    return whole if digest_bits >= 8 * DIGEST_BYTES else (int.from_bytes(whole, "big") % (1 << digest_bits)).to_bytes(DIGEST_BYTES, "big")


def _recipes(batches: Iterator[pa.RecordBatch], digest_bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, raw, offsets in text_slices(batch.column("text")):
            shas, recipes = [], []
            for i in range(end - first):
                own = raw[offsets[i] : offsets[i + 1]]
                shas.append(hashlib.sha256(own).hexdigest())
                at, parts = 0, []
                for stop in cuts(own):
                    parts.append(_digest(own[at:stop].tobytes(), digest_bits))
                    at = stop
                recipes.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, end - first), pa.array(shas), pa.array(recipes, pa.binary())], names=["doc_id", "text_sha256", "recipe"]
            )


def _chunks(batches: Iterator[pa.RecordBatch], digest_bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, raw, offsets in text_slices(batch.column("text")):
            found: dict[bytes, bytes] = {}
            clashes = []
            for i in range(end - first):
                own, at = raw[offsets[i] : offsets[i + 1]], 0
                for stop in cuts(own):
                    content = own[at:stop].tobytes()
                    digest = _digest(content, digest_bits)
                    if found.setdefault(digest, content) != content:
                        clashes.append((digest, content))
                    at = stop
            digests, contents = [*found, *(d for d, _ in clashes)], [*found.values(), *(c for _, c in clashes)]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(contents, pa.binary())], names=["digest", "content"])


def _resolved(recipes: DataFrame, source: DataFrame, clashing: DataFrame, digest_bits: int) -> DataFrame:
    """Recipes whose clashing digests carry the ordinal of their content among the digest's contents.

    A document that holds a clashing digest is compared by its whole text's chunks: its recipe
    becomes the digests followed by the ordinals, in order.
    """
    contents = (
        source.select("text").mapInArrow(lambda it: _chunks(it, digest_bits), "digest binary, content binary").join(clashing, "digest", "left_semi").distinct()
    )
    ordinals = written(contents.withColumn("ordinal", F.row_number().over(Window.partitionBy("digest").orderBy("content"))), "ordinals")
    width = DIGEST_BYTES
    touched = (
        recipes.filter("length(recipe) > 0")
        .withColumn("digest", F.explode(F.expr(f"transform(sequence(1, length(recipe), {width}), i -> substring(recipe, i, {width}))")))
        .join(clashing, "digest", "left_semi")
        .select("text_sha256", "recipe")
        .distinct()
    )
    rows = source.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)).join(touched.select("text_sha256").distinct(), "text_sha256", "left_semi")
    parts = rows.mapInArrow(lambda it: _ordered_chunks(it, digest_bits), "text_sha256 string, place long, digest binary, content binary").distinct()
    keyed = parts.join(ordinals, ["digest", "content"], "left").groupBy("text_sha256").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("ordinal", F.lit(0)).alias("ordinal")))).alias("own"))
    suffix = keyed.select("text_sha256", F.concat_ws(",", F.transform("own", lambda x: x["ordinal"].cast("string"))).alias("ordinals"))
    return recipes.join(suffix, "text_sha256", "left").select("doc_id", "text_sha256", F.concat("recipe", F.coalesce("ordinals", F.lit("")).cast("binary")).alias("recipe"))


def _ordered_chunks(batches: Iterator[pa.RecordBatch], digest_bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shas = batch.column("text_sha256").to_pylist()
        for first, end, raw, offsets in text_slices(batch.column("text")):
            rows = []
            for i in range(end - first):
                own, at = raw[offsets[i] : offsets[i + 1]], 0
                for stop in cuts(own):
                    content = own[at:stop].tobytes()
                    rows.append((shas[first + i], at, _digest(content, digest_bits), content))
                    at = stop
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))],
                names=["text_sha256", "place", "digest", "content"],
            )


def exact_duplicates(docs: DataFrame, digest_bits: int = 8 * DIGEST_BYTES) -> DataFrame:
    """Group of identical texts of every row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when all their bytes are; null counts as empty, so nulls and empty texts are one
    group. The row of the largest doc_id stays. Rows that repeat a doc_id count each and share
    ``kept``. Null doc_ids are never the largest; a group of them alone has a null ``keep_id`` and
    stays. Other columns are ignored; an empty table gives an empty result. ``digest_bits`` shortens
    chunk digests, for tests of the verification.
    """
    source = id_and_text(docs)
    recipes = written(source.mapInArrow(lambda it: _recipes(it, digest_bits), "doc_id long, text_sha256 string, recipe binary"), "recipes")
    distinct = source.select("text").mapInArrow(lambda it: _chunks(it, digest_bits), "digest binary, content binary").distinct()
    clashing = written(distinct.groupBy("digest").agg(F.count("*").alias("contents")).filter("contents > 1").select("digest"), "clashing")
    if not clashing.isEmpty():
        recipes = written(_resolved(recipes, source, clashing, digest_bits), "resolved")
    groups = written(recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    named = join_counted(recipes, groups, ["recipe"], "group_size")
    return named.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
