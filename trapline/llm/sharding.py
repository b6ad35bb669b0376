"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has ``RING_CELLS`` cells. Every shard owns ``vnodes`` points on it; a
row belongs to the first point at or after the cell of its key's hash. Shards
have quotas; keys that meet a full shard go on clockwise to the next point
whose shard has room. With quotas of ``rows / shards`` (one more for the first
``rows % shards`` shards) all quotas are filled, so row counts differ by at
most one, and only the overflow leaves its home shard.

Rows inside an arc keep their order (key hash, then the tie columns), so what a
shard takes from an arc is a run of ranks. The overflow is therefore settled on
counts per arc, a table of ``shards * vnodes`` rows whatever the input; rows
then look their run up. Everything that touches rows is a DataFrame function.

Defined cases: a null key hashes like any other value; equal keys share an arc
and are told apart by the tie columns, then at random, so a key of any size
spreads over tasks; an empty input gives no rows; columns of the input that
clash with the output names are replaced.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint_root

RING_CELLS = 8192
VNODES = 64
SALT = 20240607


def _points(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """One row per occupied cell: ``(arc, home)``; two shards on one cell: the smaller keeps it."""
    at = F.pmod(F.xxhash64(F.col("id"), F.lit(SALT)), F.lit(RING_CELLS))
    return (
        spark.range(shards * vnodes)
        .select(at.alias("arc"), F.floor(F.col("id") / vnodes).cast("int").alias("home"))
        .groupBy("arc")
        .agg(F.min("home").alias("home"))
    )


def _cells(spark: SparkSession, points: DataFrame) -> DataFrame:
    """``(cell, arc)`` for every cell: the next point clockwise (``RING_CELLS`` rows)."""
    cells = spark.range(RING_CELLS).withColumnRenamed("id", "cell")
    marked = cells.join(points.select(F.col("arc").alias("cell"), F.col("arc")), "cell", "left")
    onward = Window.orderBy("cell").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return marked.select("cell", F.coalesce(F.first("arc", ignorenulls=True).over(onward), F.min("arc").over(whole)).alias("arc"))


def settle(counts: dict[int, int], homes: dict[int, int], quotas: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(arc, from_rank, to_rank, shard, first_slot)`` that fill the quotas.

    Round by round: each shard takes what stands at its points in ring order
    until it is full; the rest moves on to the next point of a shard with room.
    Each round with a rest fills a shard, so there are at most ``len(quotas)``.
    """
    ring = sorted(homes)
    room, used = list(quotas), [0] * len(quotas)
    waiting = [(arc, arc, 0, counts.get(arc, 0)) for arc in ring if counts.get(arc, 0)]
    runs = []
    while waiting:
        rest = []
        for at, arc, lo, hi in sorted(waiting):
            shard = homes[at]
            take = min(room[shard], hi - lo)
            if take:
                runs.append((arc, lo, lo + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
            if lo + take < hi:
                rest.append((at, arc, lo + take, hi))
        open_points = [p for p in ring if room[homes[p]] > 0]
        if rest and not open_points:
            raise ValueError("the quotas hold fewer rows than there are")
        waiting = [(open_points[bisect_right(open_points, at) % len(open_points)], arc, lo, hi) for at, arc, lo, hi in rest]
    return runs


def bounded_ring(df: DataFrame, key: str, shards: int, ties: tuple[str, ...] = (), vnodes: int = VNODES) -> DataFrame:
    """``df`` with ``home_shard``, ``shard`` and ``slot`` (gapless from 0 within a shard)."""
    spark = df.sparkSession
    checkpoint_root(spark)
    points = _points(spark, shards, vnodes)
    kept = [c for c in df.columns if c.lower() not in ("home_shard", "shard", "slot")]
    order = ["_arc", "_hash", key, *ties, "_any"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = df.select(*kept, F.xxhash64(F.col(key)).alias("_hash"), F.rand(SALT).alias("_any"))
    placed = (
        hashed.withColumn("cell", F.pmod("_hash", F.lit(RING_CELLS)))
        .join(F.broadcast(_cells(spark, points).withColumnRenamed("arc", "_arc")), "cell")  # RING_CELLS rows
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select(*kept, "_arc")
        .checkpoint()  # fixes the place of every row
    )
    part = F.spark_partition_id()
    here = placed.select(*kept, "_arc", part.alias("_part"), (F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)).alias("_at"))
    # a row per arc and partition; arcs are runs of partitions
    pieces = here.groupBy("_arc", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_arc").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("_arc", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    homes = {r["arc"]: r["home"] for r in points.collect()}
    counts = {r["_arc"]: r["n"] for r in pieces.groupBy("_arc").agg(F.sum("_n").alias("n")).collect()}
    total = sum(counts.values())
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    runs = settle(counts, homes, quotas) or [(-1, 0, 0, 0, 0)]
    values = ",".join(f"({arc}L,{lo}L,{hi}L,{shard},{slot}L,{homes.get(arc, 0)})" for arc, lo, hi, shard, slot in runs)
    run = spark.sql(f"SELECT * FROM VALUES {values} AS t(_run_arc, _lo, _hi, shard, _slot0, home_shard)")
    ranked = here.join(F.broadcast(starts), ["_arc", "_part"]).withColumn("_rank", F.col("_before") + F.col("_at") - F.col("_first"))
    inside = (F.col("_arc") == F.col("_run_arc")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    return ranked.join(F.broadcast(run), inside).select(
        *kept, "home_shard", "shard", (F.col("_slot0") + F.col("_rank") - F.col("_lo")).alias("slot")
    )
