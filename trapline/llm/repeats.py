"""Which windows of a text also start earlier: the shared plan of the two substring dedups.

1. Every text gives its blocks (see ``winnow``), a row each. Rows meet by anchor:
   a block that an earlier document holds too is a duplicate, with all its windows.
2. The first holder of a block stays open if its anchor also has other blocks:
   some of its windows may stand in those. Open blocks are compared window by
   window, by the caller's method, on texts joined back by row key.

Anchors that hold more than ``HEAVY_SHARE`` of a sample's rows are salted: each
salt keeps its first holders, and those meet by whole block in a second step.

``rows`` has ``order_id`` (the document order, null ids last), ``row_key`` (equal
for rows of equal id and text) and ``text``.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path
from . import common, winnow

#: of the documents, one in so many is looked at for heavy anchors
SAMPLE = 64
HEAVY_SHARE = 1 / 4000
HEAVY_LEAST = 8
LAST_ID = (1 << 63) - 1

#: flat texts and their offsets (from 0) to units and their offsets
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def keys(text: str = "text") -> list[Column]:
    """``order_id`` and ``row_key`` of a document."""
    doc_id = F.col("doc_id").cast("long")
    return [F.coalesce(doc_id, F.lit(LAST_ID)).alias("order_id"), F.xxhash64(doc_id, F.col(text)).alias("row_key")]


def one_of_each(rows: DataFrame) -> DataFrame:
    """``rows`` with one row for each row key (those that repeat are set apart first)."""
    repeated = stored(rows.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row_key"), "repeated")
    if repeated.isEmpty():
        return rows
    single = rows.join(repeated, "row_key", "left_anti")
    return single.unionByName(rows.join(repeated, "row_key", "left_semi").dropDuplicates(["row_key"]))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps, which are stored by now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    return found


def _block_batches(batches: Iterator[pa.RecordBatch], units: Units, length: int, seed: int, heavy: np.ndarray, salts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = common.flat(batch.column("text"))
        order_id, row_key = (batch.column(c).to_numpy() for c in ("order_id", "row_key"))
        for lo, hi in common.slices(off):
            u, at = units(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            b = winnow.blocks(u, at, length, seed)
            whole = common.mix(b.anchor + common.mix(b.block) + b.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            once = np.unique(whole, return_index=True)[1]
            anchor, row = b.anchor[once], lo + b.row[once]
            salt = np.where(np.isin(anchor, heavy), 1 + row_key[row].view(np.uint64) % np.uint64(salts), 0)
            yield pa.record_batch({
                "anchor": pa.array(common.signed(anchor)), "block": pa.array(common.signed(b.block[once])),
                "salt": pa.array(salt.astype(np.int32)), "order_id": pa.array(order_id[row]), "row_key": pa.array(row_key[row]),
            })
    common.give_back()


def block_rows(rows: DataFrame, units: Units, length: int, seed: int, heavy: np.ndarray | None = None) -> DataFrame:
    """A row for each text's distinct blocks; ``salt`` is 0 but for heavy anchors."""
    heavy = np.zeros(0, np.uint64) if heavy is None else heavy
    salts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.mapInArrow(
        lambda it: _block_batches(it, units, length, seed, heavy, salts), "anchor long, block long, salt int, order_id long, row_key long"
    )


def heavy_anchors(rows: DataFrame, units: Units, length: int, seed: int) -> np.ndarray:
    """Anchors of a large share of all blocks (1 / HEAVY_SHARE of them at most), by a sample.

    It only decides how rows are dealt out, never what is found.
    """
    sample = block_rows(rows.where(F.pmod("row_key", F.lit(SAMPLE)) == 0), units, length, seed)
    counts = stored(sample.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HEAVY_LEAST), "anchors")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") >= max(HEAVY_LEAST, total * HEAVY_SHARE)).select("anchor").collect()
    return np.array(sorted(r["anchor"] for r in found), np.int64).view(np.uint64)


def block_marks(rows: DataFrame, units: Units, length: int, seed: int, within: bool) -> DataFrame:
    """``(row_key, anchor, block, duplicate)``: blocks an earlier document holds, and open ones.

    ``within``: a block is also open if only its own text has others of its anchor.
    """
    spark = rows.sparkSession
    found = block_rows(rows, units, length, seed, heavy_anchors(rows, units, length, seed))
    group = Window.partitionBy("anchor", "salt").orderBy("block", "order_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same = Window.partitionBy("anchor", "salt", "block").orderBy("order_id").rowsBetween(Window.unboundedPreceding, 0)
    several = F.first("block").over(group) != F.last("block").over(group)
    if not within:
        several &= F.min("order_id").over(group) < F.max("order_id").over(group)
    state = (
        F.when(F.col("order_id") > F.first("order_id").over(same), "duplicate")
        .when(F.col("salt") > 0, "first of salt")
        .when(several, "open")
    )
    marked = found.withColumn("state", state).where(F.col("state").isNotNull())
    marked = stored(marked.select("state", "anchor", "block", "order_id", "row_key"), "blocks")
    release(spark)
    whole = Window.partitionBy("anchor", "block").orderBy("order_id").rowsBetween(Window.unboundedPreceding, 0)
    firsts = marked.where("state = 'first of salt'")
    firsts = firsts.withColumn("state", F.when(F.col("order_id") > F.first("order_id").over(whole), "duplicate").otherwise("open"))
    return marked.where("state != 'first of salt'").unionByName(firsts).select("row_key", "anchor", "block", (F.col("state") == "duplicate").alias("duplicate"))


def open_texts(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` of texts with open blocks, and those blocks; one row for equal ids and texts."""
    opened = marks.where("NOT duplicate").groupBy("row_key").agg(F.collect_set("block").alias("open_blocks"))
    return rows.join(opened, "row_key")


def chosen(values: np.ndarray, row: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which values are in their row's list; ``row`` counts from the lists' first."""
    step = np.uint64(0x9E3779B97F4A7C15)
    off, wanted = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64)
    wanted = wanted[off[0] : off[-1]]
    if not len(wanted):
        return np.zeros(len(values), bool)
    owner = np.repeat(np.arange(len(lists), dtype=np.uint64), np.diff(off))
    return np.isin(common.mix(values + row.astype(np.uint64) * step), common.mix(wanted + owner * step))


def _window_batches(batches: Iterator[pa.RecordBatch], units: Units, length: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = common.flat(batch.column("text"))
        order_id, row_key = (batch.column(c).to_numpy() for c in ("order_id", "row_key"))
        for lo, hi in common.slices(off):
            u, at = units(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            b = winnow.blocks(u, at, length, seed)
            picked = chosen(b.block, b.row, batch.column("open_blocks").slice(lo, hi - lo))
            starts = b.windows(picked)
            if not len(starts):
                continue
            row = np.repeat(b.row[picked], (b.last - b.first + 1)[picked])
            one, two = winnow.window_hashes(u, starts, length)
            yield pa.record_batch({
                "h1": pa.array(common.signed(one)), "h2": pa.array(common.signed(two)), "start": pa.array((starts - at[row]).astype(np.int64)),
                "order_id": pa.array(order_id[lo + row]), "row_key": pa.array(row_key[lo + row]),
            })
    common.give_back()


def open_windows(rows: DataFrame, marks: DataFrame, units: Units, length: int, seed: int) -> DataFrame:
    """A row for each window of the open blocks: 128 hash bits, start, document order and row key."""
    schema = "h1 long, h2 long, start long, order_id long, row_key long"
    return open_texts(rows, marks).mapInArrow(lambda it: _window_batches(it, units, length, seed), schema)
