"""Joins whose left side may hold any share of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a key is hot beyond a part's rows divided by this, and beyond so many rows
SHARE, LEAST = 4, 200


def hot_bound(df: DataFrame, total: int) -> int:
    """Rows of a key above which it is dealt over several tasks: a fraction of a task's rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(LEAST, total // (SHARE * parts))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (few rows a key), hot keys of ``left`` dealt out by the hash of column ``by``.

    ``left`` is read more than once, so it should be a stored table. Hot keys, at most
    ``SHARE`` a partition, are broadcast; their rows of ``right`` are repeated for each part.
    """
    counts = left.groupBy(on).agg(F.count(F.lit(1)).alias("_rows"))
    total, most = counts.agg(F.sum("_rows"), F.max("_rows")).first()
    bound = hot_bound(left, total or 0)
    if (most or 0) <= bound:
        return left.join(right, on, how)
    hot = counts.where(F.col("_rows") > bound).select(*on, F.ceil(F.col("_rows") / bound).cast("int").alias("_fan"))
    rows = left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_fan").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("_fan")).cast("int")))
    other = right.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_fan", F.lit(1)) - 1)))
    return rows.drop("_fan").join(other.drop("_fan"), [*on, "_salt"], how).drop("_salt")
