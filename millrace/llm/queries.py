"""The registered query of each training-data operator: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, chat, exact_dedup, licenses, minhash, packing, pii, quality, topk, toxicity
from millrace.llm.labels import labelled, remainder
from millrace.llm.shared import id_and_text, table, written


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a call of ``reply``, every assistant turn as its result.

    Its SQL twin has those turns alone; ``op2_chat_every_turn`` has the others besides.
    """
    return chat.link_calls(*chat.from_turns(table(spark, sf_dir, "conversations")), chat.REPLY)


def op2_chat_every_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``op2_chat_formatting`` and one for every turn of another role or none."""
    return chat.every_turn(table(spark, sf_dir, "conversations"), chat.REPLY)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Counts from remainders 1 to 3 of crc32(doc_id) mod 5, the link from remainder 4; 0 is held out."""
    rows = labelled(docs, labels, "toxic").withColumn("part", remainder(5))
    return toxicity.fit(rows.filter("part between 1 and 3"), rows.filter("part = 4"))


def _decided(scored: DataFrame, parts: int, held: int) -> DataFrame:
    return scored.select("doc_id", F.coalesce(remainder(parts) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _decided(toxicity.score(id_and_text(docs), toxicity_model(docs, table(spark, sf_dir, "labels")), text=False), 5, 0)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose id is divisible by 100 against all others."""
    rows = written(topk.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    return topk.top_k(rows.filter("id % 100 = 0"), rows)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """Packed with the 50k byte-level vocabulary; its end-of-text string in a text becomes its id."""
    ranks, library = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("tiktoken", "json"))
    return packing.pack_documents(docs, ranks, public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, library_path=library)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments from remainder 0 of crc32(doc_id) mod 3, the link from remainder 2; 1 is held out."""
    docs = table(spark, sf_dir, "documents")
    rows = labelled(docs, table(spark, sf_dir, "labels"), "quality").withColumn("part", remainder(3))
    model = quality.fit(rows.filter("part = 0"), rows.filter("part = 2"))
    return _decided(quality.score(id_and_text(docs), model), 3, 1)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op2_chat_every_turn": op2_chat_every_turn,
    "op3_license_scan": op3_license_scan,
    "op4_toxicity": op4_toxicity,
    "op5_bpe": op5_bpe,
    "op6_exact_topk": op6_exact_topk,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_formatting": chat.ORACLE_SQL,
    "op2_chat_every_turn": chat.EVERY_TURN_SQL,
    "op3_license_scan": licenses.ORACLE_SQL,
    "op6_exact_topk": """
        WITH e AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        scored AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
          FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
