"""Places of rows within groups of any size, without a group in one task.

Rows are range-partitioned on group and order, so a group is a run of rows that
may go on over partitions. Only the first group of a partition can have begun
before it; how many of its rows came earlier is one number a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint_root

#: rows' global place (its upper bits are the partition) and partition
AT, PART = "_at", "_part"


def placed(rows: DataFrame, group: str, order: list) -> DataFrame:
    """``rows`` sorted by group and order over range partitions, with ``_at`` and ``_part``.

    Equal rows are told apart by where they were read, so that they spread too.
    The checkpoint fixes every row's place.
    """
    checkpoint_root(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = rows.columns
    by = [F.col(group), *order, F.col("_any")]
    ranged = rows.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return ranged.select(*kept, F.monotonically_increasing_id().alias(AT), F.spark_partition_id().alias(PART)).checkpoint()


def spanning(rows: DataFrame, group: str) -> DataFrame:
    """``(group, _part, before)`` of groups over several partitions: at most two rows a partition."""
    pieces = rows.groupBy(group, PART).agg(F.count(F.lit(1)).alias("n"))
    several = pieces.groupBy(group).agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select(group)
    before = Window.partitionBy(group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.join(several, group, "left_semi").select(group, PART, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def _numbered(batches: Iterator[pa.RecordBatch], group: str, before: dict[int, int]) -> Iterator[pa.RecordBatch]:
    last, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(group)
        new = np.ones(batch.num_rows, bool)
        new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
        if last is None:  # the partition's first group may have begun earlier
            new[0], count = False, before.get(batch.column(PART)[0].as_py(), 0)
        else:
            new[0] = keys[0] != last
        heads = np.flatnonzero(new)
        run = np.searchsorted(heads, np.arange(batch.num_rows), side="right")
        start = np.concatenate([[-count], heads])[run]
        at = np.arange(batch.num_rows) - start
        last, count = keys[len(keys) - 1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "_pos"])


def numbered(rows: DataFrame, group: str) -> DataFrame:
    """Placed ``rows`` with ``_pos``, their place in their group from 0; ``group`` has no nulls."""
    before = {r[PART]: r["before"] for r in spanning(rows, group).where("before > 0").collect()}  # a row a partition
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "_pos long"])
    return rows.mapInArrow(lambda it: _numbered(it, group, before), schema)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Sorted batches cut where the key columns change: ``(a new run begins, rows of one run)``."""
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for k in keys:
            column = batch.column(k)
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        new[0] = first != last
        cuts = np.append(np.union1d([0], np.flatnonzero(new)), n)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield bool(new[a]), batch.slice(a, b - a)
        last = tuple(batch.column(k)[n - 1].as_py() for k in keys)


def group_key(column: str) -> Column:
    """A text without nulls that sorts as the column's text does, null first."""
    text = F.col(column).cast("string")
    return F.when(text.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), text))
