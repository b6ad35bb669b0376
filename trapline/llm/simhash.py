"""SimHash near-duplicates by tiled exact comparison.

Each text gets a 64-bit fingerprint over its word shingles. Distinct
fingerprints are cut into tiles by population count (at most about
``TILE_ROWS`` of them a tile). Two fingerprints within ``radius`` bits differ by
at most ``radius`` in their counts, so only tiles whose counts are that close
meet; a pair of tiles is compared with numpy exclusive-or and bit counts, block
by block, and gives the edges of a spanning forest of its links, never all
pairs. Components come from the forests' edges.

Defined cases: a null or wordless text has fingerprint zero and links like any
other; equal texts share a fingerprint and are one point, so a group of copies
of any size costs nothing; repeated rows are kept, each with its class; a class
whose rows all have a null doc_id has a null component; an empty table gives no
rows. Only ``doc_id`` and ``text`` are read, other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_root
from . import common
from .components import component_roots

TILE_ROWS = 16384
#: fingerprints of one side compared at once with those of the other
BLOCK_ROWS = 64
BITS = 64


def fingerprints(raw: np.ndarray, off: np.ndarray, shingle: int) -> np.ndarray:
    """The fingerprint of each row's text (``off`` starts at 0)."""
    lower = common.LOWER[raw]
    start, end, words = common.word_spans(lower, off)
    out = np.zeros(len(off) - 1, np.uint64)
    if not len(start):
        return out
    flat, at = common.joined(lower, start, end)
    data = flat.tobytes()
    digest = xxhash.xxh64_intdigest
    for row in np.flatnonzero(np.diff(words)):
        a, b = int(words[row]), int(words[row + 1])
        n = max(1, b - a - shingle + 1)
        lo, hi = at[a : a + n].tolist(), (at[b - n + 1 : b + 1] - 1).tolist()
        h = np.array([digest(data[i:j], 42) for i, j in zip(lo, hi)], np.uint64)
        ones = np.zeros(BITS, np.int64)
        for k in range(0, n, 1 << 16):
            bits = np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        out[row] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = common.flat(batch.column("text"))
        parts = [np.zeros(0, np.uint64)]
        for lo, hi in common.slices(off):
            parts.append(fingerprints(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], shingle))
        fp = pa.array(common.signed(np.concatenate(parts)))
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"), "fp": fp})
    common.give_back()


def row_key() -> Column:
    """One value for rows of equal doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def fingerprint(docs: DataFrame, shingle: int) -> DataFrame:
    """``(doc_id, row_key, fp)`` for every row, the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("row_key"))
    return rows.mapInArrow(lambda it: _fingerprint_batches(it, shingle), "doc_id long, row_key long, fp long")


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of the points a[i] and b[i]; ``parent`` holds each point's smallest member."""
    while True:
        ra, rb = parent[a], parent[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        if (lo == hi).all():
            return parent
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def tile_forest(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between two tiles (or within one, given twice)."""
    points = np.unique(np.concatenate([left, right]))
    place, other = np.searchsorted(points, left), np.searchsorted(points, right)
    parent = np.arange(len(points))
    for k in range(0, len(left), BLOCK_ROWS):
        near = np.bitwise_count(left[k : k + BLOCK_ROWS, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        a, b = place[k + i], other[j]
        new = a != b
        if new.any():
            parent = _union(parent, a[new], b[new])
    child = np.flatnonzero(parent != np.arange(len(points)))
    return points[child], points[parent[child]]


def _compare_batches(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            left, right = (np.frombuffer(batch.column(c)[row].as_py(), np.uint64) for c in ("left", "right"))
            a, b = tile_forest(left, right, radius)
            yield pa.record_batch({"a": pa.array(common.signed(a)), "b": pa.array(common.signed(b))})


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("fps")
        packed = [np.asarray(lists[i].values, np.int64).tobytes() for i in range(batch.num_rows)]
        yield pa.record_batch({"ones": batch.column("ones"), "chunk": batch.column("chunk"), "fps": pa.array(packed, pa.binary())})


def links(points: DataFrame, radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Spanning edges ``(a, b)`` of the link graph over distinct ``fp``."""
    marked = points.select("fp", F.bit_count("fp").cast("int").alias("ones"))
    sizes = {r["ones"]: -(-r["n"] // tile_rows) for r in marked.groupBy("ones").agg(F.count(F.lit(1)).alias("n")).collect()}  # 65 rows at most
    chunks = F.array(*[F.lit(sizes.get(p, 0)) for p in range(BITS + 1)])
    chunk = F.pmod(F.xxhash64("fp"), F.greatest(F.get(chunks, F.col("ones")), F.lit(1))).cast("int")
    tiles = marked.groupBy("ones", chunk.alias("chunk")).agg(F.collect_list("fp").alias("fps"))  # about tile_rows a group
    tiles = tiles.mapInArrow(_pack, "ones int, chunk int, fps binary").checkpoint()
    # each tile names its partners: tiles of the same count from its own chunk on, and of up to radius more ones
    partner = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.lit(radius)),
                lambda d: F.transform(
                    F.filter(
                        F.sequence(F.lit(0), F.coalesce(F.get(chunks, F.col("ones") + d), F.lit(0))),
                        lambda c: (c < F.coalesce(F.get(chunks, F.col("ones") + d), F.lit(0))) & ((d > 0) | (c >= F.col("chunk"))),
                    ),
                    lambda c: F.struct((F.col("ones") + d).alias("ones2"), c.alias("chunk2")),
                ),
            )
        )
    )
    left = tiles.select(F.col("fps").alias("left"), partner.alias("to")).select("left", "to.ones2", "to.chunk2")
    right = tiles.select(F.col("fps").alias("right"), F.col("ones").alias("ones2"), F.col("chunk").alias("chunk2"))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.join(right, ["ones2", "chunk2"]).select("left", "right").repartition(parts)
    return pairs.mapInArrow(lambda it: _compare_batches(it, radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``(doc_id, row_key, fp, component_id)`` for every row of ``docs``."""
    checkpoint_root(docs.sparkSession)
    marks = fingerprint(docs, shingle).checkpoint()
    points = marks.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = component_roots(links(points.select("fp"), radius))  # only points that have a link
    classes = points.join(roots, points.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id", "root")
    return marks.join(named, "fp").select("doc_id", "row_key", "fp", "component_id", "root")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id (null: largest).

    Of rows that share it, the one of the smallest row key stays, and of rows
    equal in doc_id and text, any one.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    rows = near_duplicates(docs, shingle, radius).groupBy("root", "doc_id", "row_key").agg(F.count(F.lit(1)).alias("copies"))
    first = rows.groupBy("root").agg(F.min(F.struct(order.alias("at"), "copies")).alias("kept"))
    chosen = first.select(F.col("kept.at.row_key").alias("_row_key"), F.col("kept.copies").alias("_copies")).checkpoint()
    keyed = docs.withColumn("_row_key", row_key())
    kept = keyed.join(chosen.where("_copies = 1").select("_row_key"), "_row_key", "left_semi")
    repeated = chosen.where("_copies > 1").select("_row_key")
    if not repeated.isEmpty():
        kept = kept.unionByName(keyed.join(repeated, "_row_key", "left_semi").dropDuplicates(["_row_key"]))
    return kept.drop("_row_key")
