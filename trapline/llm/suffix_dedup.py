"""Substring dedup over bytes with deep-shallow sorted suffixes.

Removes every byte covered by a ``WINDOW``-byte string that also starts earlier:
in a document of smaller id, or before in the same document. Strings are judged
on the input and never cross documents.

Windows can only be equal if they share their winnowed anchor, so the suffix
array is sparse: it holds the contexts of anchors. Equal blocks (runs of windows
of one anchor) are brought together first, which keeps one of each group of
copies; the remaining blocks meet by anchor, and each task sorts their right
contexts, and their left contexts read backwards, with ``suffix_sort``. From the
two orders and their common prefixes, windows at one offset from the anchor are
equal exactly if both contexts fall into the same class of long enough prefixes;
all but the earliest of a class are removed. An anchor with more than
``HOT_BLOCKS`` different blocks would not fit one task; its windows meet by 128
hash bits instead.

Defined cases: a null text is empty; a text shorter than ``WINDOW`` loses
nothing; rows without a doc_id come after all others and, like rows of equal
doc_id, are not earlier than each other; repeated rows are each treated so; an
empty table gives no rows. Other columns are kept; columns that clash with the
output's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint_root
from . import common, repeats, winnow
from .suffix_sort import sort_suffixes

WINDOW = 100
SEED = 16
HOT_BLOCKS = 20_000
#: block bytes sorted together, at the next anchor
SORT_BYTES = 1 << 20
_BLOCK_ROWS = "anchor long, lead int, windows int, start long, order_id long, row_key long, content binary"


def byte_units(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return common.BYTE_VALUES[raw], off


def first_in_row(b: winnow.Blocks) -> np.ndarray:
    """Which blocks stand for the first time in their text."""
    whole = common.mix(b.anchor + common.mix(b.block) + b.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros(len(whole), bool)
    out[np.unique(whole, return_index=True)[1]] = True
    return out


def _open_batches(batches: Iterator[pa.RecordBatch], window: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = common.flat(batch.column("text"))
        order_id, row_key = (batch.column(c).to_numpy() for c in ("order_id", "row_key"))
        for lo, hi in common.slices(off):
            part, at = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            units, _ = byte_units(part, at)
            b = winnow.blocks(units, at, window, seed)
            picked = np.flatnonzero(repeats.chosen(b.block, b.row, batch.column("open_blocks").slice(lo, hi - lo)) & first_in_row(b))
            if not len(picked):
                continue
            first, last, row = b.first[picked], b.last[picked], b.row[picked]
            ends = np.zeros(len(picked) + 1, np.int32)
            np.cumsum(last + window - first, out=ends[1:])
            content = part[winnow.spread(first, last + window)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(common.signed(b.anchor[picked])), pa.array((b.at[picked] - first).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)),
                    pa.array(first - at[row]), pa.array(order_id[lo + row]), pa.array(row_key[lo + row]),
                    pa.BinaryArray.from_buffers(pa.binary(), len(picked), [None, pa.py_buffer(ends), pa.py_buffer(content)]),
                ],
                names=["anchor", "lead", "windows", "start", "order_id", "row_key", "content"],
            )
    common.give_back()


def repeated_windows(
    data: np.ndarray, base: np.ndarray, size: np.ndarray, lead: np.ndarray, windows: np.ndarray, start: np.ndarray, order_id: np.ndarray, row_key: np.ndarray, group: np.ndarray, window: int, seed: int
) -> np.ndarray:
    """Of each block (a row) and each of its windows (a column): does it also start earlier?

    Block i is ``data[base[i] : base[i] + size[i]]``; its anchor begins ``lead[i]``
    bytes in, and its windows at its first ``windows[i]`` bytes. Blocks of one
    ``group`` have the same anchor.
    """
    m, total = len(base), len(data)
    right, shared_right = sort_suffixes(data, base + lead + seed, size - lead - seed, group)
    left, shared_left = sort_suffixes(data[::-1].copy(), total - (base + lead), lead, group)
    out = np.zeros((m, int(windows.max(initial=0))), bool)
    class_right, class_left = np.empty(m, np.int64), np.empty(m, np.int64)
    for offset in range(window - seed + 1):  # of the anchor in the window
        rows = np.flatnonzero((offset <= lead) & (offset > lead - windows))
        if len(rows) < 2:
            continue
        class_right[right] = np.cumsum(shared_right < window - seed - offset)
        class_left[left] = np.cumsum(shared_left < offset)
        key = class_right[rows] * (m + 1) + class_left[rows]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        several = np.zeros(len(by), bool)
        several[1:] |= same
        several[:-1] |= same
        rows, key = rows[by[several]], key[by[several]]
        if not len(rows):
            continue
        at = start[rows] + lead[rows] - offset
        by = np.lexsort((at, row_key[rows], order_id[rows], key))
        rows, key, at = rows[by], key[by], at[by]
        ids, texts = order_id[rows], row_key[rows]
        new = np.ones(len(rows), bool)
        new[1:] = key[1:] != key[:-1]
        first_id = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        own = new.copy()
        own[1:] |= texts[1:] != texts[:-1]
        first_at = at[np.flatnonzero(own)][np.cumsum(own) - 1]
        again = (ids > first_id) | (at > first_at)
        out[rows[again], (lead[rows] - offset)[again]] = True
    return out


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole anchors, of about ``SORT_BYTES``; the rows come sorted by anchor."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= SORT_BYTES:
            table = pa.Table.from_batches(held)
            anchor = table.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _sort_batches(batches: Iterator[pa.RecordBatch], window: int, seed: int) -> Iterator[pa.RecordBatch]:
    for table in _sorted_runs(batches):
        data, off = common.flat(table.column("content"))
        data = data[off[0] : off[-1]]
        off = off - off[0]
        lead, windows, start, order_id, row_key, anchor = (table.column(c).to_numpy() for c in ("lead", "windows", "start", "order_id", "row_key", "anchor"))
        raw, names = data.tobytes(), {}
        base, lead = off[:-1], lead.astype(np.int64)
        # the anchor's bytes, not only its hash, make the group
        group = np.array([names.setdefault((h, raw[a : a + seed]), len(names)) for h, a in zip(anchor.tolist(), (base + lead).tolist())], np.int64)
        again = repeated_windows(data, base, np.diff(off), lead, windows.astype(np.int64), start, order_id, row_key, group, window, seed)
        edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, lo = np.nonzero(edge == 1)
        hi = np.nonzero(edge == -1)[1]
        yield pa.record_batch({"row_key": pa.array(row_key[row]), "lo": pa.array(start[row] + lo), "hi": pa.array(start[row] + hi)})
    common.give_back()


def sorted_repeats(rows: DataFrame, marks: DataFrame, window: int, seed: int) -> DataFrame:
    """``(row_key, lo, hi)``: runs of window starts in open blocks that also start earlier."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    opened = repeats.open_texts(rows, marks).mapInArrow(lambda it: _open_batches(it, window, seed), _BLOCK_ROWS)
    dealt = opened.repartition(parts, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(lambda it: _sort_batches(it, window, seed), "row_key long, lo long, hi long")


def hashed_repeats(rows: DataFrame, marks: DataFrame, window: int, seed: int) -> DataFrame:
    """The same for the blocks of anchors with very many of them."""
    found = repeats.open_windows(rows, marks, byte_units, window, seed)
    own = found.groupBy("h1", "h2", "order_id", "row_key").agg(F.min("start").alias("own_start"))
    earliest = own.groupBy("h1", "h2").agg(F.min("order_id").alias("first_id"))
    again = found.join(earliest, ["h1", "h2"]).join(own, ["h1", "h2", "order_id", "row_key"])
    return again.where("order_id > first_id OR start > own_start").select("row_key", F.col("start").alias("lo"), (F.col("start") + 1).alias("hi"))


def _cut_batches(batches: Iterator[pa.RecordBatch], window: int, seed: int, kept: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = common.flat(batch.column("text"))
        blocks, runs = batch.column("blocks"), batch.column("runs")
        for lo, hi in common.slices(off):
            part, at = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            b = winnow.blocks(byte_units(part, at)[0], at, window, seed)
            dup = repeats.chosen(b.block, b.row, blocks.slice(lo, hi - lo)) | ~first_in_row(b)
            mine = runs.slice(lo, hi - lo)
            cuts = np.asarray(mine.offsets)
            pairs = mine.values.slice(int(cuts[0]), int(cuts[-1] - cuts[0]))
            base = np.repeat(at[:-1], np.diff(cuts))
            found = winnow.spread(base + pairs.field("lo").to_numpy(), base + pairs.field("hi").to_numpy())
            gone = winnow.covered(np.unique(np.concatenate([b.windows(dup), found])), window, len(part))
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            heads = at[:-1][at[:-1] < len(part)]
            edge[heads] = gone[heads]  # a run ends with its text
            count, spans = np.zeros(len(part) + 1, np.int64), np.zeros(len(part) + 1, np.int64)
            np.cumsum(~gone, out=count[1:])
            np.cumsum(edge, out=spans[1:])
            left = part[~gone].tobytes()
            ends = count[at]
            texts = [left[a:z] for a, z in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(lo, hi - lo) for c in kept), pa.array(texts, pa.binary()),
                    pa.array(np.diff(at)), pa.array(np.diff(at) - np.diff(ends)), pa.array(np.diff(spans[at])),
                ],
                names=[*kept, "kept_bytes", "n_bytes", "n_removed", "n_spans"],
            )
    common.give_back()


def suffix_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """``docs`` with ``kept_bytes``, ``n_bytes``, ``n_removed`` and ``n_spans`` (maximal removed runs)."""
    spark = docs.sparkSession
    checkpoint_root(spark)
    ours = {"kept_bytes", "n_bytes", "n_removed", "n_spans", "order_id", "row_key", "blocks", "runs", "open_blocks"}
    kept = [c for c in docs.columns if c.lower() not in ours]
    docs = docs.select(*[F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in kept])
    keyed = docs.select("*", *repeats.keys())
    rows = repeats.one_of_each(keyed.select("order_id", "row_key", "text"))
    marks = repeats.block_marks(rows, byte_units, window, seed, within=True)
    opened = marks.where("NOT duplicate")
    hot = opened.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_blocks).select("anchor")
    hot = repeats.stored(hot, "hot")
    crowded = not hot.isEmpty()
    runs = sorted_repeats(rows, opened.join(hot, "anchor", "left_anti") if crowded else opened, window, seed)
    if crowded:
        runs = runs.unionByName(hashed_repeats(rows, opened.join(hot, "anchor", "left_semi"), window, seed))
    runs = repeats.stored(runs, "runs")
    repeats.release(spark)
    run = "struct<lo:long,hi:long>"
    both = marks.where("duplicate").select("row_key", "block", F.lit(None).cast(run).alias("run"))
    both = both.unionByName(runs.select("row_key", F.lit(None).cast("long").alias("block"), F.struct("lo", "hi").alias("run")))
    cuts = both.groupBy("row_key").agg(F.collect_set("block").alias("blocks"), F.collect_list("run").alias("runs"))
    joined = keyed.join(cuts, "row_key", "left").select(
        *kept, F.coalesce("blocks", F.array().cast("array<long>")).alias("blocks"), F.coalesce("runs", F.array().cast(f"array<{run}>")).alias("runs")
    )
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "kept_bytes binary, n_bytes long, n_removed long, n_spans long"])
    return joined.mapInArrow(lambda it: _cut_batches(it, window, seed, kept), schema)
