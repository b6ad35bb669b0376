"""Merkle manifest of a dataset: trees of three-way runs in the van Emde Boas layout.

Every tree's leaves, in order, are cut into aligned blocks of ``3 ** HEIGHT``
leaves. A block is one stored row: its nodes lie in the van Emde Boas order, a
complete tree split at half its height, the upper part first, then the lower
ones one after the other, each part laid out the same way. ``addresses`` is that
arithmetic; it serves both the building of a block, level by level, and the
reading of siblings. Block roots are the leaves of the next round, until every
tree has one block; the trees' roots, in order, make a last tree.

A tree's leaves are placed by range partitions, so a tree may hold any share of
the rows; a task holds one block at a time. Rounds grow with the logarithm of
the largest tree to the base ``3 ** HEIGHT``.

Defined cases: null fields are hashed as ``-``; a null tree key is a tree of its
own, before all others; leaves of one tree ascend by the order columns, nulls
first, then by digest, so repeated rows and ids have equal results whatever
their places; an empty text is a value; a tree of one leaf is that leaf, and
likewise the root of one tree; an empty table gives no rows, no blocks and no
root. Of the input only the named columns are used, so other columns may have
any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ordering

ARITY = 3
#: a block's levels above its leaves: 729 leaves
HEIGHT = 6
#: bytes of blocks handed on at once
_FLUSH = 2 << 20

_BLOCKS = "tree string, block long, leaves long, height int, nodes binary"
_BLOCK_ROWS = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("leaves", pa.int64()), ("height", pa.int32()), ("nodes", pa.binary())])
_PROOF = "left array<binary>, right array<binary>"


def size(levels: int) -> int:
    """Nodes of a complete tree."""
    return (ARITY**levels - 1) // (ARITY - 1)


@lru_cache
def addresses(levels: int) -> list[np.ndarray]:
    """For each depth, where its nodes lie in the layout of a complete tree."""
    if levels == 1:
        return [np.zeros(1, np.int64)]
    upper = levels // 2
    lower = levels - upper
    first = size(upper) + np.arange(ARITY**upper) * size(lower)
    return [*addresses(upper), *((first[:, None] + a).reshape(-1) for a in addresses(lower))]


def grow(leaves: np.ndarray, height: int) -> np.ndarray:
    """The laid out nodes over ``(n, 32)`` leaf digests; the root is the first."""
    place = addresses(height + 1)
    nodes = np.zeros((size(height + 1), 32), np.uint8)
    n = len(leaves)
    nodes[place[height][:n]] = leaves
    for depth in range(height - 1, -1, -1):
        text = nodes[place[depth + 1][:n]].tobytes().hex().encode()
        step = ARITY * 64
        digests = b"".join(hashlib.sha256(text[i : i + step]).digest() for i in range(0, len(text), step))
        n = len(digests) // 32
        nodes[place[depth][:n]] = np.frombuffer(digests, np.uint8).reshape(-1, 32)
    return nodes


def siblings(nodes: np.ndarray, leaves: int, height: int, at: np.ndarray) -> tuple[list[list[bytes]], list[list[bytes]]]:
    """Per level from the leaves up: each asked leaf's siblings to the left, and to the right."""
    place, left, right = addresses(height + 1), [], []
    for level in range(height):
        count = -(-leaves // ARITY**level)
        row = nodes[place[height - level][:count]].tobytes()
        own = at // ARITY**level
        first = own - own % ARITY
        last = np.minimum(first + ARITY, count)
        left.append([row[32 * a : 32 * b] for a, b in zip(first.tolist(), own.tolist())])
        right.append([row[32 * a + 32 : 32 * b] for a, b in zip(own.tolist(), last.tolist())])
    return left, right


def lone_height(n: int) -> int:
    height = 0
    while ARITY**height < n:
        height += 1
    return height


def _grow_batches(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    full = ARITY**height
    out, held = [], 0

    def close(key: tuple[str, int], parts: list[np.ndarray]) -> dict:
        leaves = np.concatenate(parts)
        # a first block that is not full is its whole tree
        levels = lone_height(len(leaves)) if key[1] == 0 and len(leaves) < full else height
        return {"tree": key[0], "block": key[1], "leaves": len(leaves), "height": levels, "nodes": grow(leaves, levels).tobytes()}

    key, parts = None, []
    for new, run in ordering.runs(batches, ["tree", "block"]):
        if new:
            if parts:
                out.append(close(key, parts))
                held += len(out[-1]["nodes"]) + 200
            key, parts = (run.column("tree")[0].as_py(), run.column("block")[0].as_py()), []
            if held > _FLUSH:
                yield pa.RecordBatch.from_pylist(out, _BLOCK_ROWS)
                out, held = [], 0
        parts.append(np.frombuffer(b"".join(run.column("digest").to_pylist()), np.uint8).reshape(-1, 32))
    if parts:
        out.append(close(key, parts))
    if out:
        yield pa.RecordBatch.from_pylist(out, _BLOCK_ROWS)


def _grown(leaves: DataFrame, height: int) -> DataFrame:
    """Blocks over ``(tree, pos, digest)``."""
    dealt = leaves.select("tree", F.expr(f"pos div {ARITY**height}").alias("block"), "pos", "digest")
    return dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(lambda it: _grow_batches(it, height), _BLOCKS)


def _root(nodes: str = "nodes") -> Column:
    return F.substring(nodes, 1, 32)


def _forest(leaves: DataFrame, path: str, height: int) -> list[str]:
    """Blocks of all rounds, a table each."""
    spark, tables = leaves.sparkSession, []
    while True:
        tables.append(f"{path}/round={len(tables)}")
        _grown(leaves, height).write.mode("overwrite").parquet(tables[-1])
        blocks = spark.read.schema(_BLOCKS).parquet(tables[-1])
        if not blocks.agg(F.max("block")).first()[0]:
            return tables
        leaves = blocks.select("tree", F.col("block").alias("pos"), _root().alias("digest"))


def _lists(columns: list[list[bytes]], n: int, path: list[bytes]) -> pa.Array:
    """A list a leaf: its own levels, then those of the block's path."""
    size = len(columns) + len(path)
    values = [v for i in range(n) for v in (*(c[i] for c in columns), *path)]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * size, max(size, 1))[: n + 1] if size else np.zeros(n + 1), pa.int32()), pa.array(values, pa.binary()))


def _proof_batches(batches: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Leaf rows with their proofs; each block's rows follow the block itself (``tag`` 0)."""
    for new, run in ordering.runs(batches, ["tree", "block"]):
        if new:
            head = run.slice(0, 1).to_pylist()[0]
            nodes = np.frombuffer(head["nodes"], np.uint8).reshape(-1, 32)
            first = head["block"] * ARITY ** head["height"]
            run = run.slice(1)
        if not run.num_rows:
            continue
        at = run.column("pos").to_numpy() - first
        left, right = siblings(nodes, head["leaves"], head["height"], at)
        arrays = [_lists(left, len(at), head["left"]), _lists(right, len(at), head["right"])]
        yield pa.RecordBatch.from_arrays([*(run.column(c) for c in kept), *arrays], names=[*kept, "left", "right"])


def _proved(leaves: DataFrame, blocks: DataFrame, height: int, kept: list[str]) -> DataFrame:
    """``kept`` columns of ``(tree, pos, ...)`` and the proofs read from ``blocks`` with their own paths."""
    block_columns = ["leaves", "height", "nodes", "left", "right"]
    rows = leaves.select("tree", F.expr(f"pos div {ARITY**height}").alias("block"), F.lit(1).alias("tag"), "pos", *[c for c in kept if c not in ("tree", "pos")])
    heads = blocks.select("tree", "block", F.lit(0).alias("tag"), *block_columns)
    both = heads.unionByName(rows, allowMissingColumns=True).repartition("tree", "block").sortWithinPartitions("tree", "block", "tag", "pos")
    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema}
    return both.mapInArrow(lambda it: _proof_batches(it, kept), ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), _PROOF]))


def _paths(spark: SparkSession, tables: list[str], tree_paths: DataFrame, height: int) -> DataFrame:
    """First-round blocks with the proofs of their roots; ``tree_paths`` has those of the trees' roots."""
    none = F.array().cast("array<binary>")
    above = tree_paths.withColumn("block", F.lit(0).cast("long"))
    for k in range(len(tables) - 1, -1, -1):
        blocks = spark.read.schema(_BLOCKS).parquet(tables[k]).join(above, ["tree", "block"], "left")
        blocks = blocks.withColumns({c: F.coalesce(c, none) for c in ("left", "right")})
        if k:
            below = spark.read.schema(_BLOCKS).parquet(tables[k - 1]).select("tree", F.col("block").alias("pos"))
            above = _proved(below, blocks, height, ["tree", "pos"]).withColumnRenamed("pos", "block")
    return blocks


@dataclass
class Manifest:
    """A written manifest: block tables of the trees and of the tree over them, and the placed leaves."""

    leaves: DataFrame
    trees: list[str]
    top: list[str]
    height: int

    def subroots(self, spark: SparkSession) -> DataFrame:
        """``(tree, subroot)``."""
        return spark.read.schema(_BLOCKS).parquet(self.trees[-1]).select("tree", _root().alias("subroot"))

    def root(self, spark: SparkSession) -> bytes | None:
        found = spark.read.schema(_BLOCKS).parquet(self.top[-1]).select(_root().alias("root")).first()
        return bytes(found["root"]) if found else None


def build(rows: DataFrame, path: str, order: list[str], height: int = HEIGHT) -> Manifest:
    """Write the manifest of ``rows`` below ``path``.

    ``rows`` has ``tree`` (see ``ordering.group_key``), ``digest`` (32 bytes) and
    the order columns; further columns go along with the leaves.
    """
    spark = rows.sparkSession
    by = [*(F.col(c).asc_nulls_first() for c in order), F.col("digest")]
    leaves = ordering.numbered(ordering.placed(rows, "tree", by), "tree").withColumnRenamed("_pos", "pos")
    trees = _forest(leaves, f"{path}/trees", height)
    subroots = spark.read.schema(_BLOCKS).parquet(trees[-1]).select(F.lit("").alias("tree"), F.col("tree").alias("name"), _root().alias("digest"))
    ranked = ordering.numbered(ordering.placed(subroots, "tree", [F.col("name")]), "tree")
    names = ranked.select("name", F.col("_pos").alias("pos"))
    names.write.mode("overwrite").parquet(f"{path}/names")
    top = _forest(ranked.withColumnRenamed("_pos", "pos"), f"{path}/top", height)
    return Manifest(leaves, trees, top, height)


def prove(spark: SparkSession, manifest: Manifest, path: str, columns: list[str]) -> DataFrame:
    """The leaves' ``columns`` with ``subroot`` and their siblings to the root, level by level."""
    names = spark.read.schema("name string, pos long").parquet(f"{path}/names").select(F.lit("").alias("tree"), "pos", "name")
    none = spark.createDataFrame([], f"tree string, {_PROOF}")
    tree_paths = _proved(names, _paths(spark, manifest.top, none, manifest.height), manifest.height, ["name"])
    tree_paths = tree_paths.select(F.col("name").alias("tree"), "left", "right")
    blocks = _paths(spark, manifest.trees, tree_paths, manifest.height)
    kept = ["tree", *columns]
    return _proved(manifest.leaves, blocks, manifest.height, kept)


def digest_of(columns: list[Column]) -> Column:
    """A leaf: each field ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    fields = []
    for c in columns:
        text = c.cast("string")
        fields.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def fold(leaf: Column, left: Column, right: Column) -> Column:
    """The root, as hex text, that a leaf and its proof give."""
    return F.aggregate(
        F.arrays_zip(left.alias("l"), right.alias("r")),
        hex_text(leaf),
        lambda got, run: F.sha2(F.concat(hex_text(run["l"]), got, hex_text(run["r"])).cast("binary"), 256),
    )


def proof_digest(left: Column, right: Column) -> Column:
    """Hash of all siblings of a proof, level by level."""
    runs = F.transform(F.arrays_zip(left.alias("l"), right.alias("r")), lambda run: F.concat(hex_text(run["l"]), hex_text(run["r"])))
    return F.sha2(F.array_join(runs, "").cast("binary"), 256)
