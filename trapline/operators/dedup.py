"""Exact duplicate removal.

``dedup_keep_first``: one row per key, the one with the lowest id. One
shuffle on the key; the partial (map-side) aggregate collapses repeats of a
hot key before the shuffle, so a record resubmitted a billion times costs one
row per map task, not a billion rows in one reducer.

``dedup_within``: the same over a stream with bounded state, for repeats that
arrive within a horizon.

``drop_seen``: rows of a new batch whose key is not stored yet (left anti
join). NULLs never match, like the ``=`` lookups of the original.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY7


def dedup_keep_first(df: DataFrame, key=None, id_col: str = "id") -> DataFrame:
    """Keep, per key, the row with the smallest ``id_col``; NULL keys group
    together (GROUP BY semantics). Output columns keep the input order."""
    key = list(key or KEY7)
    others = [c for c in df.columns if c not in key and c != id_col]
    if not others:
        out = df.groupBy(*key).agg(F.min(id_col).alias(id_col))
    else:
        first = F.min(F.struct(F.col(id_col), *[F.col(c) for c in others])).alias("_first")
        out = df.groupBy(*key).agg(first).select(*key, "_first.*")
    return out.select(*df.columns)


def drop_seen(new: DataFrame, stored: DataFrame, key=None) -> DataFrame:
    """Rows of ``new`` whose key does not occur in ``stored``."""
    key = list(key or KEY7)
    return new.join(stored.select(*key), on=key, how="left_anti")


def dedup_within(stream: DataFrame, arrival: str, horizon: str, key=None) -> DataFrame:
    """Rows of a stream whose key did not arrive in the ``horizon`` before them.

    The state holds a row for each key until the watermark on ``arrival`` has
    passed its first arrival by the horizon; its size follows the horizon, not
    the history. On a batch DataFrame all repeats go."""
    return stream.withWatermark(arrival, horizon).dropDuplicatesWithinWatermark(list(key or KEY7))
