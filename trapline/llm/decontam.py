"""Benchmark decontamination by latent semantic retrieval and exact checks.

Words are lower-cased runs of letters and digits. The benchmark's items are cut
into passages; their TF-IDF matrix, with document frequencies counted over the
whole corpus, is factored by a distributed randomised singular value
decomposition: each multiplication is a Spark job over the passages whose
partial products are summed by blocks of terms. Every window of ``WINDOW`` words
of every document (one begins each ``STEP`` words) is folded into that latent
space and compared with all passages by cosine; pairs of at least ``COSINE`` are
candidates. So that a short item is not lost among its window's other words, wider
windows, one of which holds any passage whole, are compared by the part of the
passage's weight that they cover, whatever else they hold; from ``COVERED`` on they
are candidates, so a word for word copy always is one. A candidate is a leak if the longest common subsequence of the item
and a stretch of the document of about its length holds ``COPIED`` of the item's
words, or ``PARAPHRASED`` of them if the item's answer, its last sentence, also
stands there word for word. The cosine reported is that of the window that found
the leak.

A space has at most ``RANK`` passages (more only if one item alone has more) and
as many directions as passages, so it holds each of them whole and a benchmark's
size does not matter to what is found. Tasks get the vectors and words of all
spaces of a part, at most ``MAX_PASSAGES`` passages (or one item) at a time; a
larger benchmark is searched in parts, each over all documents.

Defined cases: a null or wordless text has no leaks; items that are null or have
fewer than ``LEAST_WORDS`` words are not searched for; of items of equal id the
texts are searched for one by one; repeated rows are each reported; an empty
documents table gives no rows, an empty benchmark no leaks. Other columns are
kept; a column named ``leaks`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, STEP = 48, 24
PASSAGE = 64
RANK, SPARE, POWER = 224, 16, 2
#: blocks of STEP words in a wide window, and from one to the next: any PASSAGE words lie in one
WIDE, WIDE_STEP = 5, 2
COSINE, COVERED = 0.6, 0.6
COPIED, PARAPHRASED = 0.8, 0.6
LEAST_WORDS, ANSWER_WORDS = 6, 3
MAX_PASSAGES = 4096
#: terms whose rows of a product are summed together, and windows compared at once
TERM_BLOCK, WINDOW_BLOCK = 256, 4096


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of texts, and the texts' offsets into them."""
    lower = common.LOWER[raw]
    start, end, words = common.word_spans(lower, off, common.LETTERS)
    return common.word_hashes(lower, start, end), words


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words_of(raw, np.array([0, len(raw)]))[0]


def common_subsequence(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence with ``words``; bit i of a word's mask: the item's word i."""
    full = (1 << n) - 1
    row = full
    for w in words:
        if m := masks.get(w, 0):
            met = row & m
            row = ((row + met) | (row - met)) & full
    return n - row.bit_count()


@dataclass
class Item:
    item_id: int
    words: list[int]
    answer: list[int]

    def __post_init__(self) -> None:
        self.masks: dict[int, int] = {}
        for i, w in enumerate(self.words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i

    def share(self, words: list[int]) -> float:
        """The largest common share of the item in a stretch of a quarter more than its length."""
        n = len(self.words)
        if (most := common_subsequence(self.masks, n, words) / n) < PARAPHRASED:
            return most  # no stretch has more than the whole
        span, step = n + n // 4 + 2, max(1, n // 8)
        ends = range(0, max(1, len(words) - span + step), step)
        return max(common_subsequence(self.masks, n, words[k : k + span]) for k in ends) / n

    def answered(self, words: list[int]) -> bool:
        a = self.answer
        return len(a) >= ANSWER_WORDS and any(words[k : k + len(a)] == a for k in range(len(words) - len(a) + 1))

    def leaked(self, words: list[int]) -> float | None:
        """The common share, if it makes a leak."""
        share = self.share(words)
        return share if share >= COPIED or (share >= PARAPHRASED and self.answered(words)) else None


def item_of(item_id: int, text: str) -> Item:
    sentences = [x for x in re.split(r"[.!?\n]+", text) if re.search(r"\w", x)]
    return Item(item_id, _hashes(text).tolist(), _hashes(sentences[-1]).tolist() if len(sentences) > 1 else [])


class Vocabulary:
    """Columns of the benchmark's words; a bitmap turns most other words away."""

    BITS = 20

    def __init__(self, known: np.ndarray):
        self.known = np.unique(known)
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[(self.known & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are known, and their columns."""
        at = np.flatnonzero(self.maybe[(words & np.uint64((1 << self.BITS) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.known, words[at]), len(self.known) - 1)
        real = self.known[place] == words[at]
        return at[real], place[real]


def _frequency_batches(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    n, total = len(vocabulary.known), 0
    df = np.zeros(n, np.int64)
    for batch in batches:
        raw, off = common.flat(batch.column("text"))
        for lo, hi in common.slices(off):
            hashes, words = words_of(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            at, column = vocabulary.find(hashes)
            row = np.searchsorted(words, at, side="right") - 1
            df += np.bincount(np.unique(row * n + column) % n, minlength=n)
            total += hi - lo
    yield pa.record_batch({"term": pa.array([*range(n), -1]), "df": pa.array([*df.tolist(), total])})


def inverse_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _frequency_batches(it, vocabulary), "term long, df long")
    df = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    return np.log((1 + df.get(-1, 0)) / (1 + np.array([df.get(i, 0) for i in range(len(vocabulary.known))]))) + 0.1


def _product_batches(batches: Iterator[pa.RecordBatch], basis: np.ndarray) -> Iterator[pa.RecordBatch]:
    """This part's A' (A basis), by blocks of terms."""
    total = np.zeros(basis.shape)
    for batch in batches:
        for column, weight in zip(batch.column("columns"), batch.column("weights")):
            c, w = np.asarray(column.values), np.asarray(weight.values)
            np.add.at(total, c, w[:, None] * (w @ basis[c]))
    blocks = range(0, len(total), TERM_BLOCK)
    yield pa.record_batch({"block": pa.array(list(blocks), pa.int64()), "part": pa.array([total[k : k + TERM_BLOCK].tobytes() for k in blocks], pa.binary())})


def _sum_parts(table: pa.Table) -> pa.Table:
    parts = table.column("part").to_pylist()
    return pa.table({"block": table.column("block")[:1], "part": pa.array([sum(np.frombuffer(p) for p in parts).tobytes()], pa.binary())})


def randomised_svd(rows: DataFrame, terms: int, rank: int = RANK, spare: int = SPARE, power: int = POWER) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of a sparse matrix.

    ``rows`` has ``columns array<long>`` and ``weights array<double>``. A random
    projection is multiplied by A'A ``power + 1`` times; the driver only holds
    matrices of terms x (rank + spare).
    """
    width = min(rank + spare, terms)
    basis = np.random.default_rng(11).standard_normal((terms, width))
    for _ in range(power + 1):
        basis = np.linalg.qr(basis)[0]
        parts = rows.mapInArrow(lambda it, b=basis: _product_batches(it, b), "block long, part binary")
        summed = parts.groupBy("block").applyInArrow(_sum_parts, "block long, part binary").collect()
        product = np.zeros((terms, width))
        for r in summed:
            product[r["block"] : r["block"] + TERM_BLOCK] = np.frombuffer(r["part"]).reshape(-1, width)
        last, basis = basis, product
    # the Rayleigh-Ritz step orders the directions by their singular values
    value, turn = np.linalg.eigh((last.T @ basis + basis.T @ last) / 2)
    kept = [i for i in np.argsort(value)[::-1][:rank] if value[i] > 1e-9 * max(value.max(), 1e-300)]
    return last @ turn[:, kept]


@dataclass
class Model:
    vocabulary: Vocabulary
    fold: np.ndarray  # a latent row for each term, weighted by its IDF
    passages: np.ndarray  # latent vectors of length 1
    weight: np.ndarray  # the passages' lengths before
    owner: np.ndarray  # the passages' items
    items: list[Item]

    def windows(self, hashes: np.ndarray, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Text and first word of each window, and the windows' latent vectors; then those of the wide windows."""
        size = np.diff(words)
        count = -(-size // STEP)  # blocks of a text
        ends = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=ends[1:])
        row = np.repeat(np.arange(len(size)), count)
        first = words[row] + (np.arange(ends[-1]) - ends[row]) * STEP
        at, column = self.vocabulary.find(hashes)
        sums = np.zeros((len(first) + 1, self.fold.shape[1]), np.float32)
        if len(at):
            block = np.searchsorted(first, at, side="right") - 1
            head = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            sums[block[head]] = np.add.reduceat(self.fold[column], head, axis=0)
        # a window is a block and the next one of its text; a last lone block belongs to the window before
        more = np.zeros(len(first), bool)
        more[:-1] = row[1:] == row[:-1]
        whole = sums[:-1] + np.where(more[:, None], sums[1:], 0)
        keep = more | (count[row] == 1)
        # a wide window is some blocks of a text; one that adds none to the wide window before is left out
        place = np.arange(len(first)) - ends[row]
        start = np.flatnonzero((place % WIDE_STEP == 0) & ((place == 0) | (count[row] - place > WIDE - WIDE_STEP)))
        wide = sums[start]
        for k in range(1, WIDE):
            there = start + k < ends[row[start] + 1]
            wide[there] += sums[start[there] + k]
        return [(row[keep], first[keep], whole[keep]), (row[start], first[start], wide)]

    def leaks(self, hashes: np.ndarray, words: np.ndarray) -> list[tuple[int, int, float, float]]:
        """``(text, item, cosine, share)`` of every leak in texts of these words."""
        found: dict[tuple[int, int], tuple[float, float]] = {}
        for wide, (row, first, x) in enumerate(self.windows(hashes, words)):
            length = WIDE * STEP if wide else WINDOW
            size = np.sqrt(np.einsum("ij,ij->i", x, x))
            some = np.flatnonzero(size > 0)
            for k in range(0, len(some), WINDOW_BLOCK):
                pick = some[k : k + WINDOW_BLOCK]
                near = (x[pick] / size[pick, None]) @ self.passages.T
                for i, j in zip(*np.nonzero(near * size[pick, None] >= COVERED * self.weight if wide else near >= COSINE)):
                    w, number = pick[i], int(self.owner[j])
                    key = int(row[w]), number
                    if key in found:
                        continue
                    item = self.items[number]
                    n = len(item.words)
                    lo, hi = max(words[row[w]], first[w] - n), min(words[row[w] + 1], first[w] + length + n)
                    share = item.leaked(hashes[lo:hi].tolist())
                    if share is not None:
                        found[key] = float(near[i, j]), share
        return [(r, i, *v) for (r, i), v in sorted(found.items())]


def passages_of(item: Item) -> list[np.ndarray]:
    starts = range(0, max(1, len(item.words) - PASSAGE // 2), PASSAGE // 2)
    return [np.array(item.words[k : k + PASSAGE], np.uint64) for k in starts]


def grouped(items: Iterable[Item], most: int) -> Iterator[list[Item]]:
    """The items in groups of at most ``most`` passages, or of one item."""
    held, passages = [], 0
    for item in items:
        more = len(passages_of(item))
        if held and passages + more > most:
            yield held
            held, passages = [], 0
        held.append(item)
        passages += more
    if held:
        yield held


def fit(docs: DataFrame, items: list[Item]) -> list[Model]:
    """The latent spaces of the items' passages, with frequencies of ``docs``."""
    every = Vocabulary(np.array([w for i in items for w in i.words], np.uint64))
    idf = inverse_frequencies(docs, every)
    return [_space(docs.sparkSession, group, every, idf) for group in grouped(items, RANK)]


def _space(spark: SparkSession, items: list[Item], every: Vocabulary, every_idf: np.ndarray) -> Model:
    """The latent space of one group of items; it has a direction for each passage."""
    vocabulary = Vocabulary(np.array([w for i in items for w in i.words], np.uint64))
    idf = every_idf[np.searchsorted(every.known, vocabulary.known)]
    rows, lengths, owner = [], [], []
    for number, item in enumerate(items):
        for words in passages_of(item):
            column, n = np.unique(vocabulary.find(words)[1], return_counts=True)
            weight = n * idf[column]
            lengths.append(np.linalg.norm(weight))
            rows.append((len(rows), column.tolist(), (weight / lengths[-1]).tolist()))
            owner.append(number)
    passages = spark.createDataFrame(rows, "passage long, columns array<long>, weights array<double>")
    space = randomised_svd(passages, len(vocabulary.known), max(RANK, len(rows)))
    latent = np.zeros((len(rows), space.shape[1]))
    for i, column, weight in rows:
        latent[i] = np.array(weight) @ space[column]
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    return Model(vocabulary, (space * idf[:, None]).astype(np.float32), latent.astype(np.float32), np.array(lengths, np.float32), np.array(owner), items)


def parts_of(benchmark: DataFrame) -> Iterator[list[Item]]:
    """The items that are searched for, in parts of at most MAX_PASSAGES passages, or of one item."""
    texts = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    items = (item_of(r["item_id"], r["text"]) for r in texts.orderBy("item_id", "text").toLocalIterator())
    return grouped((i for i in items if len(i.words) >= LEAST_WORDS), MAX_PASSAGES)


def _leak_slice(models: list[Model], raw: np.ndarray, off: np.ndarray) -> dict[str, pa.Array]:
    hashes, words = words_of(raw, off)
    found = [(r, m.items[i].item_id, c, s) for m in models for r, i, c, s in m.leaks(hashes, words)]
    found.sort(key=lambda x: x[0])  # stable: items stay in order
    at = np.zeros(len(off), np.int32)
    np.cumsum(np.bincount([r for r, *_ in found], minlength=len(off) - 1), out=at[1:])
    columns = [
        pa.array([i for _, i, _, _ in found], pa.int64()), pa.array([c for _, _, c, _ in found], pa.float64()),
        pa.array([s for _, _, _, s in found], pa.float64()),
    ]
    return {"leaks": pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(columns, names=["item_id", "cosine", "share"]))}


LEAKS = "array<struct<item_id:long,cosine:double,share:double>>"


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``leaks``: the benchmark items each document holds."""
    out = docs.select(*[c for c in docs.columns if c.lower() != "leaks"]).withColumn("_leaks", F.array().cast(LEAKS))
    for items in parts_of(benchmark):
        models = fit(docs, items)
        more = common.add_columns(out, lambda raw, off, m=models: _leak_slice(m, raw, off), {"leaks": LEAKS})
        out = more.withColumn("_leaks", F.concat("_leaks", "leaks")).drop("leaks")
    return out.withColumnRenamed("_leaks", "leaks")
