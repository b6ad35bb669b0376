"""Quality by nearest-neighbour voting in a latent-semantic space.

A document's terms describe how it is written: the shape of its words (case,
digits, marks), pairs of neighbouring shapes, word lengths, and whether words
and lines repeat ones before them. Terms are hashed into ``TERMS`` columns and
weighted by TF-IDF, with document frequencies counted over all documents. A
truncated singular value decomposition of labelled documents gives the latent
space. Their vectors, a bounded number, go to every task; each document is
compared with all of them by blocked exact cosines, and its ``NEIGHBOURS``
nearest vote with their similarity as weight.

The fit uses at most ``MAX_EACH`` documents of each label and at most
``MAX_BYTES`` bytes each, in the order of a hash; votes are weighted so that the
labels count as often as they stand among all usable labels. Scoring reads every
text whole.

Defined cases: a null or empty text has no terms and gets the share of label 1;
rows with a null label or id are not learned from; repeated labels count once;
ties between neighbours go to the earlier of the sample; with labels of one kind
every score is that label, with none 0.5; an empty table gives no rows. Other
columns are kept; a column named ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TERMS = 2048
RANK = 64
NEIGHBOURS = 25
MAX_EACH, MAX_BYTES = 1000, 20_000
BLOCK_ROWS = 256
LONGEST = 20

_SHAPE = np.arange(256, dtype=np.int64) + 4
for _i in range(256):
    if _i >= 128 or chr(_i).islower():
        _SHAPE[_i] = 1
    elif chr(_i).isupper():
        _SHAPE[_i] = 2
    elif chr(_i).isdigit():
        _SHAPE[_i] = 3
_SHAPE_VALUES = common.mix(_SHAPE.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_KINDS = common.mix(np.arange(8, dtype=np.uint64))
_LINES = np.ones(256, bool)
_LINES[0x0A] = False


def _seen_before(row: np.ndarray, values: np.ndarray) -> np.ndarray:
    whole = common.mix(values + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.ones(len(whole), bool)
    out[np.unique(whole, return_index=True)[1]] = False
    return out


def terms(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every term of the texts."""
    start, end, words = common.word_spans(raw, off)
    rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(row: np.ndarray, value: np.ndarray, kind: int) -> None:
        rows.append(row)
        columns.append((common.mix(value + _KINDS[kind]) % np.uint64(TERMS)).astype(np.int64))

    if len(start):
        row = np.repeat(np.arange(len(off) - 1), np.diff(words))
        # a shape: the word's classes of bytes, runs of one class as one
        shape = _SHAPE[raw]
        kept = np.ones(len(raw), bool)
        kept[1:] = shape[1:] != shape[:-1]
        kept[start] = True
        at = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(kept, out=at[1:])
        shapes = common.Prefix(_SHAPE_VALUES[raw[kept]]).spans(at[start], at[end])
        word = common.word_hashes(raw, start, end)
        add(row, shapes, 1)
        add(row, np.minimum(end - start, LONGEST).astype(np.uint64), 2)
        add(row, _seen_before(row, word).astype(np.uint64), 3)
        for gap in (1, 2):
            near = row[gap:] == row[:-gap]
            add(row[gap:][near], (word[gap:] == word[:-gap])[near].astype(np.uint64), 3 + gap)
        near = row[1:] == row[:-1]
        add(row[1:][near], common.mix(shapes[:-1][near]) + shapes[1:][near], 6)
        start, end, lines = common.word_spans(raw, off, _LINES)
        row = np.repeat(np.arange(len(off) - 1), np.diff(lines))
        add(row, _seen_before(row, common.word_hashes(raw, start, end)).astype(np.uint64), 7)
    return np.concatenate(rows), np.concatenate(columns)


def counts(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Term counts of blocks of rows, dense: ``(from, to, rows x TERMS)``."""
    row, column = terms(raw, off)
    order = np.argsort(row, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, len(off) - 1, BLOCK_ROWS):
        hi = min(lo + BLOCK_ROWS, len(off) - 1)
        a, b = np.searchsorted(row, [lo, hi])
        yield lo, hi, np.bincount((row[a:b] - lo) * TERMS + column[a:b], minlength=(hi - lo) * TERMS).reshape(hi - lo, TERMS)


def _frequency_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(TERMS, np.int64), 0
    for batch in batches:
        raw, off = common.flat(batch.column("text"))
        for lo, hi in common.slices(off):
            for _, _, block in counts(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]):
                total += (block > 0).sum(axis=0)
                n += len(block)
    yield pa.record_batch({"term": pa.array([*range(TERMS), -1]), "df": pa.array([*total.tolist(), n])})


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """IDF of each term column over all documents (``TERMS`` numbers)."""
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_frequency_batches, "term long, df long")
    df = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    return np.log((1 + df.get(-1, 0)) / (1 + np.array([df.get(i, 0) for i in range(TERMS)]))) + 0.1


@dataclass
class Model:
    idf: np.ndarray
    space: np.ndarray  # TERMS x rank
    vectors: np.ndarray  # labelled documents, of length 1
    labels: np.ndarray
    weights: np.ndarray  # of each labelled document's vote
    prior: float

    def latent(self, block: np.ndarray) -> np.ndarray:
        x = (np.log1p(block) * self.idf).astype(np.float32) @ self.space
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(size > 0, size, 1)

    def vote(self, block: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(block), self.prior)
        x = self.latent(block)
        near = x @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        edge = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
        above = near > edge  # of equal neighbours at the edge the earlier ones
        tied = near == edge
        chosen = above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        weight = np.where(chosen, np.maximum(near, 0), 0) * self.weights
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * self.labels).sum(axis=1) / np.where(total > 0, total, 1), self.prior).clip(0, 1)


def fit(texts: list[str], labels: list[int], idf: np.ndarray, share: float) -> Model:
    """A model of labelled documents; ``share`` is that of label 1 among all labels."""
    none = np.zeros((0, RANK), np.float32)
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(idf, none, none, y[:0], y[:0], float(y[0]) if len(y) else 0.5)
    raw, off = common.flat(pa.array(texts, pa.large_string()))
    x = np.concatenate([(np.log1p(block) * idf).astype(np.float32) for lo, hi in common.slices(off) for _, _, block in counts(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    # the leading right singular vectors, by random projection and power steps
    basis = np.random.default_rng(7).standard_normal((TERMS, RANK + 16)).astype(np.float32)
    for _ in range(4):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    space = (basis @ np.linalg.svd(x @ basis, full_matrices=False)[2].T)[:, :RANK].astype(np.float32)
    vectors = x @ space
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors /= np.where(size > 0, size, 1)
    weights = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(idf, space, vectors, y, weights, share)


def training_sample(docs: DataFrame, labels: DataFrame, max_each: int = MAX_EACH) -> tuple[list[str], list[int], float]:
    """Texts and labels of a bounded sample and the share of label 1; ``labels`` has ``doc_id`` and ``quality``."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("_label"))
    share = known.agg(F.avg("_label")).first()[0]
    some = [known.where(F.col("_label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_each) for v in (0, 1)]
    picked = some[0].unionByName(some[1])
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= MAX_BYTES)
    rows = texts.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()  # 2 * max_each rows
    return [r["text"] for r in rows], [r["_label"] for r in rows], float(share if share is not None else 0.5)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, the weighted share of label 1 among the neighbours."""

    def work(raw: np.ndarray, off: np.ndarray) -> dict[str, pa.Array]:
        return {"score": pa.array(np.concatenate([model.vote(block) for _, _, block in counts(raw, off)]).astype(np.float64))}

    return common.add_columns(docs, work, {"score": "double"})
