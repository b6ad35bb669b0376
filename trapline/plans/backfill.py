"""Backfill: the flat first-generation table -> coded fact + dictionaries.

Steps of the original migrations, as one batch job:
  trim evidence (blank, tab, LF, CR) -> drop rows with a NULL text column or
  time -> exact dedup keeping the lowest id -> six dictionaries -> encode.

The original removed duplicates *before* trimming and again relied on a
unique index afterwards; trimming first and deduplicating once keeps the
lowest id among rows that are equal after trimming, which is the same result
without a second shuffle, and cannot leave duplicates behind.
Ids of the fact rows are the surviving legacy ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedup, dictionary, filters
from ..schema import KEY7, TEXT_COLUMNS


def clean_legacy(legacy: DataFrame) -> DataFrame:
    """Legacy rows -> decoded attacks: trimmed, complete, unique on KEY7."""
    df = legacy.select(
        "id",
        F.col("attack_timestamp").alias("timestamp"),
        *[text.trim_blanks(c).alias(c) if c == "evidence" else F.col(c) for c in TEXT_COLUMNS],
    )
    df = filters.drop_incomplete(df, TEXT_COLUMNS, time_col="timestamp")
    return dedup.dedup_keep_first(df, KEY7, "id").select("id", *KEY7)


def backfill(legacy: DataFrame):
    """-> (fact, dictionaries, attacks). ``attacks`` is the cleaned decoded
    table; it is checkpointed once since three consumers read it."""
    attacks = clean_legacy(legacy).checkpoint(eager=True)
    dicts = dictionary.build_dictionaries(attacks)
    fact = dictionary.encode(attacks, dicts).select("id", "timestamp", *TEXT_COLUMNS)
    return fact, dicts, attacks
