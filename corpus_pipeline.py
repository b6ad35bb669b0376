"""A training-corpus pipeline over ``documents``.

Each stage is ``f(spark, docs, sf_dir) -> DataFrame`` and works on what the one
before it kept; between stages the documents are written as Parquet and read
again. All but the last return the columns of ``documents``:

1. toxicity: documents with a toxicity score of ``TOXIC`` or more go;
2. simhash_near_dedup: one document of each group of near duplicates stays;
3. substring_dedup: 13-word passages that an earlier document holds are cut from
   the text (a text that loses words has single spaces; others stay as they are);
4. benchmark_decontamination: documents that hold a benchmark item go;
5. sentencepiece: token ids, their number, and digests of the ids and of the
   text decoded from them.

Columns beside ``doc_id`` and ``text`` travel in one struct, so whatever their
names, they cannot clash with an operator's own. ``n_chars``, if there, follows
the text. Nulls, empty texts, ties, repeated rows and empty tables are treated
as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm import decontam, queries, repeats, simhash, substring_dedup, toxicity
from trapline.llm.shipping import prepare

TOXIC = 0.7
SHINGLE, RADIUS = 4, 4
_ROW = "documents_row"


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, and the whole row as a struct without its text."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias(_ROW))


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col(f"{_ROW}.`{c}`").alias(c) for c in columns])


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity bound."""
    rows = _packed(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(rows, queries.toxicity_model(rows, labels))
    return _unpacked(scored.where(F.col("score") < TOXIC), docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return _unpacked(simhash.keep_one(_packed(docs), shingle=SHINGLE, radius=RADIUS), docs.columns)


def substring_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in earlier ones."""
    rows = substring_dedup.substring_dedup(_packed(docs))
    cut = rows.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    out = _unpacked(cut, docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _unpacked(decontam.find_leaks(_packed(docs), benchmark).where(F.size("leaks") == 0), docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the digests of an exact round trip."""
    prepare(spark)
    return queries.token_digests(docs, queries.piece_model())


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_cut),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: no SQL: a fitted classifier, component search and merges; tests/llm checks it against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = repeats.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
