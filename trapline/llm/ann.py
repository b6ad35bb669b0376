"""Approximate nearest neighbours with a forest of random-projection trees.

Every tree splits its node's sample points by a random direction at their
median. The hyperplanes are fitted on at most ``SAMPLE_ROWS`` vectors, in the
order of a hash; every vector is then put into its leaf of every tree. A query
walks all trees from one priority queue: the branch with the least sum of
squared distances to the hyperplanes crossed goes next, whichever tree it is
in, until the leaves hold about ``search_share`` times as many places as there
are vectors (a vector has a place in every tree). Leaves and the queries that
come to them meet in tasks; a task compares them block by block, in double
precision, and hands on only the nearest of each query.

How far to search for a given recall is a matter of the data: vectors without
any clusters, spread over a sphere of 64 dimensions, need a share above 1 for a
recall of 0.95, clustered ones far less. Leaves have about ``LEAF_ROWS`` points
as long as the sample supports the depth.

Equal vectors are one point of the index that carries its ``k + 1`` smallest
ids; more of them can never be among the k nearest, so a vector that holds any
share of all rows costs no more than another, and none is lost.

Defined cases: vectors that are null, all zero, hold a null or a non-finite
value or have another length than most take no part, neither do rows without an
id; ties in distance go to the smaller id; repeated rows (equal id and vector)
count once; a query excludes rows of its own id; with fewer than k candidates
all found are returned; an empty table gives no rows. Only the id and the vector
are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint_root

TREES = 8
LEAF_ROWS = 128
SEARCH_SHARE = 1.5
SAMPLE_ROWS = 65_536
#: sample points that a leaf needs at least
SAMPLE_LEAF = 8
#: cells of a block of distances, and results a task holds before it hands them on
BLOCK_CELLS = 1 << 20
HELD_ROWS = 500_000


@dataclass
class Tree:
    """Node i has the children 2i + 1 and 2i + 2; ``depth`` levels of splits."""

    normals: np.ndarray
    offsets: np.ndarray
    depth: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            side = np.einsum("ij,ij->i", x, self.normals[node]) > self.offsets[node]
            node = 2 * node + 1 + side
        return node


def grow(sample: np.ndarray, depth: int, seed: int) -> Tree:
    """A tree whose splits halve the sample; a node without points gets an arbitrary split."""
    rng = np.random.default_rng(seed)
    inner = (1 << depth) - 1
    normals = rng.standard_normal((inner, sample.shape[1])).astype(np.float32)
    normals /= np.linalg.norm(normals, axis=1, keepdims=True)
    offsets = np.zeros(inner, np.float32)
    node = np.zeros(len(sample), np.int64)
    for level in range(depth):
        first = (1 << level) - 1
        place = np.einsum("ij,ij->i", sample, normals[node])
        order = np.lexsort((place, node))
        cuts = np.searchsorted(node[order], np.arange(first, 2 * first + 2))
        for k in range(first + 1):
            lo, hi = cuts[k], cuts[k + 1]
            if hi > lo:
                mid = (lo + hi) // 2
                offsets[first + k] = (place[order[mid]] + place[order[max(lo, mid - 1)]]) / 2
        node = 2 * node + 1 + (place > offsets[node])
    return Tree(normals, offsets, depth)


@dataclass
class Forest:
    trees: list[Tree]

    def search(self, query: np.ndarray, leaves: int) -> list[tuple[int, int]]:
        """``(tree, leaf)`` of the nearest branches over all trees, by one priority queue."""
        sides = [t.normals @ query - t.offsets for t in self.trees]
        queue = [(0.0, i, 0, 0) for i in range(len(self.trees))]
        found = []
        while queue and len(found) < leaves:
            far, i, node, level = heapq.heappop(queue)
            while level < self.trees[i].depth:
                margin = float(sides[i][node])
                near = 2 * node + 1 + (margin > 0)
                other = 2 * node + 2 - (margin > 0)
                heapq.heappush(queue, (far + margin * margin, i, other, level + 1))
                node, level = near, level + 1
            found.append((i, node))
        return found


def plant(sample: np.ndarray, rows: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS) -> Forest:
    """A forest for ``rows`` vectors from a sample of them."""
    depth = 0
    while rows > leaf_rows << depth and len(sample) >= SAMPLE_LEAF << (depth + 1):
        depth += 1
    return Forest([grow(sample, depth, 1000 + i) for i in range(trees)])


def points(vectors: DataFrame, k: int, vec_id: str, vector: str) -> tuple[DataFrame, DataFrame, int]:
    """Usable rows ``(vec_id, v)``, distinct points ``(point, v, ids)`` with their k + 1 smallest ids, and the dimension."""
    kind = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    v = F.col(vector).cast(f"array<{kind}>")
    usable = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & usable)
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    dimension = sizes["n"] if sizes else 1
    # -0.0 and 0.0 are the same place
    place = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x))
    rows = rows.where(F.size("v") == dimension).withColumn("v", place).distinct()
    order = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)  # at most k + 1 from a task go into the shuffle
    distinct = kept.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return rows, distinct.select(F.col("ids")[0].alias("point"), "v", "ids"), dimension


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    off = np.asarray(column.offsets)
    return np.asarray(column.values)[off[0] : off[-1]].reshape(-1, dimension)


def _placed(tree: np.ndarray, leaf: np.ndarray, ids: np.ndarray, is_query: bool, vectors: pa.Array) -> pa.RecordBatch:
    return pa.record_batch({
        "tree": pa.array(tree.astype(np.int32)), "leaf": pa.array(leaf.astype(np.int32)), "is_query": pa.array(np.full(len(ids), is_query)),
        "id": pa.array(ids), "v": vectors,
    })


def _leaf_batches(batches: Iterator[pa.RecordBatch], forest: Forest, dimension: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, ids = _matrix(batch.column("v"), dimension).astype(np.float32), batch.column("id").to_numpy()
        for i, tree in enumerate(forest.trees):
            yield _placed(np.full(len(x), i), tree.leaves(x), ids, False, batch.column("v"))


def _probe_batches(batches: Iterator[pa.RecordBatch], forest: Forest, dimension: int, leaves: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, ids = _matrix(batch.column("v"), dimension).astype(np.float32), batch.column("id").to_numpy()
        for row in range(len(x)):
            found = np.array(forest.search(x[row], leaves))
            yield _placed(found[:, 0], found[:, 1], np.repeat(ids[row], len(found)), True, batch.column("v").take(pa.array([row] * len(found))))


def block_nearest(queries: np.ndarray, members: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of queries, rows of members and exact distances of (at least) the k nearest of each query."""
    # around the members' middle, and with room for what the product rounds otherwise than the
    # distance: that grows with a vector's length, however small the distances are
    middle = members.mean(axis=0)
    qs, ms = queries - middle, members - middle
    q2, m2 = (qs**2).sum(axis=1), (ms**2).sum(axis=1)
    near = q2[:, None] + m2[None, :] - 2 * qs @ ms.T
    if members.shape[0] > k:
        eps, n = np.finfo(np.float64).eps, members.shape[1]
        room = [8 * eps * ((n + 4) * x2 + np.sqrt(n * x2) * np.abs(x).max(axis=1)) for x, x2 in ((queries, q2), (members, m2))]
        most = np.partition(near + room[1], k - 1, axis=1)[:, k - 1]
        q, m = np.nonzero(near - room[1] <= (most + 2 * room[0])[:, None])
    else:
        q, m = np.nonzero(np.ones(near.shape, bool))
    return q, m, np.sqrt(((queries[q] - members[m]) ** 2).sum(axis=1))


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest different points of each query."""
    query, point, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((point, score, query))
    query, point, score = query[order], point[order], score[order]
    new = np.ones(len(query), bool)  # the same point from another tree has the same distance
    new[1:] = (query[1:] != query[:-1]) | (point[1:] != point[:-1])
    query, point, score = query[new], point[new], score[new]
    head = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    nth = np.arange(len(query)) - np.repeat(head, np.diff(np.append(head, len(query))))
    return query[nth < k], point[nth < k], score[nth < k]


def _leaf_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table for each (tree, leaf); the rows come sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = (batch.column("tree").to_numpy().astype(np.int64) << 32) | batch.column("leaf").to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if held and (held[0].column("tree")[0], held[0].column("leaf")[0]) != (batch.column("tree")[lo], batch.column("leaf")[lo]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _meet_batches(batches: Iterator[pa.RecordBatch], dimension: int, k: int) -> Iterator[pa.RecordBatch]:
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def out(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch({"query": pa.array(rows[0]), "point": pa.array(rows[1]), "score": pa.array(rows[2])})

    for table in _leaf_groups(batches):
        is_query, ids = table.column("is_query").to_numpy(), table.column("id").to_numpy()
        x = _matrix(table.column("v").combine_chunks(), dimension).astype(np.float64)
        queries, members = x[is_query], x[~is_query]
        if not len(queries) or not len(members):
            continue
        step_m = min(len(members), BLOCK_CELLS)
        step_q = max(1, BLOCK_CELLS // step_m)
        for i in range(0, len(queries), step_q):
            for j in range(0, len(members), step_m):
                q, m, score = block_nearest(queries[i : i + step_q], members[j : j + step_m], k)
                found.append((ids[is_query][i + q], ids[~is_query][j + m], score))
        if sum(len(f[0]) for f in found) > HELD_ROWS:
            found = [_best(found, k)]
            if len(found[0][0]) > HELD_ROWS // 2:
                yield out(found.pop())
    if found:
        yield out(_best(found, k))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, search_share: float = SEARCH_SHARE, trees: int = TREES, leaf_rows: int = LEAF_ROWS, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; queries are the rows for which ``is_query``, a condition on ``vec_id``, holds."""
    spark = vectors.sparkSession
    checkpoint_root(spark)
    rows, distinct, dimension = points(vectors, k, vec_id, vector)
    distinct = distinct.checkpoint()
    sample = distinct.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE_ROWS).collect()  # SAMPLE_ROWS at most
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = plant(np.array([r["v"] for r in sample], np.float32), distinct.count(), trees, leaf_rows)
    del sample
    leaves = max(1, min(trees << forest.trees[0].depth, round(search_share * (1 << forest.trees[0].depth))))
    # equal query vectors search once
    asked = rows.where(is_query).select("vec_id", "v")
    wanted = asked.groupBy("v").agg(F.min("vec_id").alias("id"))
    kind = f"tree int, leaf int, is_query boolean, id long, v {rows.schema['v'].dataType.simpleString()}"
    members = distinct.select(F.col("point").alias("id"), "v").mapInArrow(lambda it: _leaf_batches(it, forest, dimension), kind)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    probes = wanted.select("id", "v").repartition(parts).mapInArrow(lambda it: _probe_batches(it, forest, dimension, leaves), kind)
    dealt = members.unionByName(probes).repartition(parts, "tree", "leaf").sortWithinPartitions("tree", "leaf", "is_query")
    # the k + 1 nearest points hold the k nearest other ids: each comes with its least id
    met = dealt.mapInArrow(lambda it: _meet_batches(it, dimension, k + 1), "query long, point long, score double").distinct()
    near = met.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("score", "point"))).where(F.col("nth") <= k + 1)
    named = near.join(distinct.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    each = asked.join(wanted.withColumnRenamed("id", "query"), "v").select(F.col("vec_id").alias("query_id"), "query")
    others = each.join(named, "query").where(F.col("vec_id") != F.col("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return others.select("query_id", place.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
