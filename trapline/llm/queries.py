"""The registered queries of this subpackage: thin digests of each operator's output.

Each takes ``(spark, sf_dir)``, applies its operator to the whole table and
returns the columns of its contract.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import ann, bpe, decontam, jaccard, merkle, ordering, quality, repair, sharding, simhash, substring_dedup, suffix_dedup, toxicity, warc
from .oracle import OP11_SQL, OP12_SQL, OP13_SQL
from .shipping import prepare

SHARDS = 8
TOXIC, GOOD = 0.7, 0.3


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
), later AS (
  SELECT doc_id, i FROM win JOIN (SELECT s, min(doc_id) AS lo FROM win GROUP BY s) USING (s) WHERE doc_id > lo
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM later)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS n FROM pages
), k AS (
  SELECT payload, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY payload
)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.payload) AS payload_digest,
       CASE WHEN keeper IS NULL OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper IS NULL OR page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM p LEFT JOIN k USING (payload)
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards whose row counts differ by at most one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = sharding.bounded_ring(docs, "doc_id", SHARDS, ties=("size", "text_crc32"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 13-word windows that start in an earlier one."""
    rows = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a WARC archive and read back."""
    root = scratch_path(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), root)
    return warc.read(spark, root, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 100-byte strings that start earlier."""
    rows = suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and class."""
    rows = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _held_out(parts: int, rest: int) -> Column:
    """Rows that are not learned from: crc32 of the id as text leaves ``rest`` on division."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == rest, F.lit(False))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Fitted on labelled rows that are not held out."""
    return toxicity.fit(*toxicity.training_sample(docs, labels.where(~_held_out(3, 1))))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.score(docs, toxicity_model(docs, _table(spark, sf_dir, "labels")))
    return rows.select("doc_id", _held_out(3, 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontam.find_leaks(docs, _table(spark, sf_dir, "benchmark"))
    return rows.where(F.size("leaks") > 0).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.cosine", "leak.share")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest embeddings of every hundredth one."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~_held_out(5, 0))
    texts, known, share = quality.training_sample(docs, labels)
    model = quality.fit(texts, known, quality.inverse_frequencies(docs), share)
    rows = quality.score(docs, model)
    return rows.select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def piece_model() -> str:
    """The vocabulary file: ``TRAPLINE_PIECE_MODEL``, or the installed public one."""
    if found := os.environ.get("TRAPLINE_PIECE_MODEL"):
        return found
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_digests(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, ids)`` of each row's ids and of the text decoded from them."""
    rows = bpe.round_trip(docs.select("doc_id", "text"), model)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    decoded = F.sha2(F.col("decoded").cast("binary"), 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), decoded.alias("decoded_sha256"), "ids")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the 32k piece vocabulary and decoded again."""
    return token_digests(_table(spark, sf_dir, "documents"), piece_model()).drop("ids")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule, with its faults and the cheapest repair."""
    rows = _table(spark, sf_dir, "conversations")
    return repair.repair(repair.damaged(rows), rows)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and component of linked sets."""
    rows = jaccard.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_shingles", "component_id")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and roots, checked again after damage to some texts."""
    docs = _table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    damaged = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    bare = merkle.digest_of([*fields[:4], F.translate("text", "\n", "")])
    leaf = merkle.digest_of(fields)
    rows = docs.select(ordering.group_key("source").alias("tree"), "doc_id", leaf.alias("digest"), F.when(damaged, bare).alias("tampered"))
    path = scratch_path(spark, "merkle")
    manifest = merkle.build(rows, path, ["doc_id"])
    root = manifest.root(spark)
    proved = merkle.prove(spark, manifest, path, ["doc_id", "digest", "tampered"])
    root_text = F.lit(root.hex() if root else None).cast("string")
    subroots = manifest.subroots(spark)
    found = proved.select(
        "tree", "doc_id", merkle.hex_text(F.col("digest")).alias("leaf"), root_text.alias("root"),
        merkle.proof_digest(F.col("left"), F.col("right")).alias("proof_sha256"),
        merkle.fold(F.coalesce("tampered", "digest"), F.col("left"), F.col("right")).alias("folded_root"),
    )
    return found.join(subroots, "tree").select(
        "doc_id", "leaf", merkle.hex_text(F.col("subroot")).alias("subroot"), "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_warc": op3_warc,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_simhash_near_dedup": op5_simhash_near_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_decontamination": op7_decontamination,
        "op8_nearest_neighbours": op8_nearest_neighbours,
        "op9_quality": op9_quality,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_jaccard_join": op12_jaccard_join,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": OP2_SQL,
        "op3_warc": OP3_SQL,
        "op11_conversation_repair": OP11_SQL,
        "op12_jaccard_join": OP12_SQL,
        "op13_merkle_manifest": OP13_SQL,
    }
