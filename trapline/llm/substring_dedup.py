"""Substring dedup over words: seed and extend.

Documents are joined on winnowed anchors of ``SEED`` words; the matches are
extended both ways to all windows of ``WINDOW`` words around the anchor, first
as whole blocks, then, where blocks differ, window by window. Overlapping
windows found in an earlier document make up the maximal repeats, whose words
are removed. Windows are judged on the input.

Defined cases: a null text has no words; a text of fewer than ``WINDOW`` words
loses none; rows without a doc_id come after all others and are not earlier
than each other, nor are rows of equal doc_id; repeated rows are each treated
so; an empty table gives no rows. Other columns are kept; columns of the input
that clash with the output's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_root
from . import common, repeats, shingles, winnow

WINDOW = 13
SEED = 5


def word_units(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, words = common.word_spans(raw, off)
    return shingles.word_hashes(raw, start, end), words


def _cut_batches(batches: Iterator[pa.RecordBatch], window: int, seed: int, kept: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = common.flat(batch.column("text"))
        blocks, windows = batch.column("blocks"), batch.column("windows")
        for lo, hi in common.slices(off):
            part, at = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            start, end, words = common.word_spans(part, at)
            units = shingles.word_hashes(part, start, end)
            b = winnow.blocks(units, words, window, seed)
            starts = [b.windows(repeats.chosen(b.block, b.row, blocks.slice(lo, hi - lo)))]
            wanted = windows.slice(lo, hi - lo)
            if len(b.first) and wanted.offsets[-1].as_py() > wanted.offsets[0].as_py():
                every = b.windows(np.ones(len(b.first), bool))
                row = np.repeat(b.row, b.last - b.first + 1)
                starts.append(every[repeats.chosen(winnow.window_hashes(units, every, window)[0], row, wanted)])
            gone = winnow.covered(np.unique(np.concatenate(starts)), window, len(units))
            left = ~gone
            flat, place = common.joined(part, start[left], end[left])
            count = np.zeros(len(units) + 1, np.int64)
            np.cumsum(left, out=count[1:])
            first = place[count[words]]
            data = flat.tobytes()
            texts = [data[a : max(a, b - 1)].decode("utf-8", "replace") for a, b in zip(first[:-1], first[1:])]
            n_words = np.diff(words)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(lo, hi - lo) for c in kept), pa.array(texts, pa.string()), pa.array(n_words), pa.array(n_words - np.diff(count[words]))],
                names=[*kept, "kept_text", "n_words", "n_removed"],
            )
    common.give_back()


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs`` with ``kept_text`` (kept words joined by one space), ``n_words`` and ``n_removed``."""
    spark = docs.sparkSession
    checkpoint_root(spark)
    ours = {"kept_text", "n_words", "n_removed", "order_id", "row_key", "blocks", "windows", "open_blocks"}
    kept = [c for c in docs.columns if c.lower() not in ours]
    docs = docs.select(*[F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in kept])
    keyed = docs.select("*", *repeats.keys())
    rows = repeats.one_of_each(keyed.select("order_id", "row_key", "text"))
    marks = repeats.block_marks(rows, word_units, window, seed, within=False)
    found = repeats.stored(repeats.open_windows(rows, marks, word_units, window, seed).select("h1", "h2", "order_id", "row_key"), "windows")
    repeats.release(spark)
    shared = found.groupBy("h1", "h2").agg(F.min("order_id").alias("first_id"), F.max("order_id").alias("last_id")).where("first_id < last_id")
    later = found.join(shared, ["h1", "h2"]).where("order_id > first_id").select("row_key", F.lit(None).cast("long").alias("block"), F.col("h1").alias("window"))
    later = repeats.stored(later, "repeats")
    repeats.release(spark)
    both = marks.where("duplicate").select("row_key", "block", F.lit(None).cast("long").alias("window")).unionByName(later)
    cuts = both.groupBy("row_key").agg(F.collect_set("block").alias("blocks"), F.collect_set("window").alias("windows"))
    none = F.array().cast("array<long>")
    joined = keyed.join(cuts, "row_key", "left").select(*kept, F.coalesce("blocks", none).alias("blocks"), F.coalesce("windows", none).alias("windows"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "kept_text string, n_words long, n_removed long"])
    return joined.mapInArrow(lambda it: _cut_batches(it, window, seed, kept), schema)
