"""Counts per local minute, kept beside a store and merged on read.

The per-minute view and the hourly and daily reports need nothing of a row but its
minute. ``refresh`` counts the rows that came in since the last one and writes a part
of ``(_minute, count)``; a read sums the parts and counts the few rows that no part
covers yet. So a read costs the number of minutes, and a refresh the new rows, however
many rows are stored.

What the parts cover is a bound on ids: the ingest gives every row an id above all
earlier ones and reserves it before the row is written. A refresh covers the ids up to
the reserved mark; a row is in a part or above the bound, never both, also after a
refresh or a batch that was cut off. A batch write brings in ids of its own, so it
begins a new generation of parts (``store.begin_generation``), and the next refresh
counts everything again.

Layout: ``<root>/minutes/<table>/<zone>/<generation>/``, holding ``parts`` (a row for
each part in use and the last id it covers) and a numbered folder for each part. After ``MERGE_AT``
parts the next refresh merges all. Folders are used in turn, a part in use is never
written to. If ``parts`` is lost, the next read and refresh count all rows: slower,
not wrong. One ingest at a time writes to a store, and refreshes it.

Defined cases: rows without a local text of their time (years outside 0000 to 9999)
count under a null minute; an empty store gives no rows; null ids, which only batch
writes bring, are counted by the first refresh of a generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timefn as T
from ..operators.filters import since_local
from ..sources import store
from . import views

COUNTS = "_minute long, count long"
PARTS = "part int, upto long"
#: parts that are read one beside the other before they are merged
MERGE_AT = 32


def _home(spark: SparkSession, root: str, tz: str | None, table: str) -> str:
    zone = "".join(c if c.isalnum() else f"_{ord(c):x}" for c in T.resolve_tz(tz))
    return f"{root}/minutes/{table}/{zone}/{store.generation(spark, root)}"


def _parts(spark: SparkSession, home: str) -> list[tuple[int, int]]:
    """The parts in use, the latest last: ``MERGE_AT`` + 1 at most."""
    if not store.path_exists(spark, f"{home}/parts"):
        return []
    return sorted(((r["part"], r["upto"]) for r in spark.read.schema(PARTS).parquet(f"{home}/parts").collect()), key=lambda p: p[1])


def _stored(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    if not store.table_exists(spark, root, table):
        return None
    return store.read_fact(spark, root) if table == "fact" else store.read_attacks(spark, root)


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("_minute").agg(F.sum("count").alias("count"))


def _rolled(spark: SparkSession, home: str, parts: list[tuple[int, int]]) -> DataFrame:
    return spark.read.schema(COUNTS).parquet(*[f"{home}/{n}" for n, _ in parts])


def refresh(spark: SparkSession, root: str, tz: str | None = None, table: str = "attacks") -> None:
    """Count the rows that came in since the last refresh."""
    rows = _stored(spark, root, table)
    if rows is None:
        return
    home = _home(spark, root, tz, table)
    parts = _parts(spark, home)
    top = store.reserve_ids(spark, root, 0) - 1
    if parts:
        if parts[-1][1] >= top:
            return
        # the greatest and least id of a file's parts spare most of the older files
        rows = rows.filter((F.col("id") > parts[-1][1]) & (F.col("id") <= top))
    counts, kept = views.minute_counts(rows, tz), parts
    if len(parts) >= MERGE_AT:
        counts, kept = _summed(_rolled(spark, home, parts).unionByName(counts)), []
    used = {n for n, _ in parts}
    folders = 2 * MERGE_AT + 2
    after = parts[-1][0] + 1 if parts else 0
    part = next(n for n in ((after + k) % folders for k in range(folders)) if n not in used)
    # a row a minute: a file holds a span of minutes, which a cut-off passes over
    counts.repartitionByRange("_minute").sortWithinPartitions("_minute").write.mode("overwrite").parquet(f"{home}/{part}")
    spark.createDataFrame([*kept, (part, top)], PARTS).coalesce(1).write.mode("overwrite").parquet(f"{home}/parts")


def minute_counts(spark: SparkSession, root: str, tz: str | None = None, table: str = "attacks", as_of=None, days: int | None = None) -> DataFrame:
    """``(_minute, count)`` of all stored rows; with ``days``, at least of those since ``days`` before ``as_of``."""
    rows = _stored(spark, root, table)
    if rows is None:
        return spark.createDataFrame([], COUNTS)
    home = _home(spark, root, tz, table)
    parts = _parts(spark, home)
    rows = rows.filter(F.col("id") > parts[-1][1]) if parts else rows
    late = views.minute_counts(rows if days is None else since_local(rows, as_of, days), tz)
    return _summed(_rolled(spark, home, parts).unionByName(late)) if parts else late


def view_attacks_by_time(spark: SparkSession, root: str, tz: str | None = None, table: str = "attacks", **_) -> DataFrame:
    return views.by_time_from_minutes(minute_counts(spark, root, tz, table))


def view_daily_attacks(spark: SparkSession, root: str, tz: str | None = None, table: str = "attacks", **_) -> DataFrame:
    day = T.floor_div(F.col("_minute"), 24 * 60).alias("_day")
    days = minute_counts(spark, root, tz, table).select(day, "count").groupBy("_day").agg(F.sum("count").alias("count"))
    return views.daily_from_stage(days, None)


def _report(name: str):
    def report(spark: SparkSession, root: str, as_of=None, tz: str | None = None, table: str = "attacks", days: int | None = None, **_) -> DataFrame:
        width, unit, usual = views.BUCKET_REPORTS[name]
        days = usual if days is None else days
        return views.totals_from_minutes(minute_counts(spark, root, tz, table, as_of, days), as_of, tz, days, width, unit)

    report.__name__ = name
    return report


#: the views that read nothing but minute counts: fn(spark, root, as_of=, tz=, table=)
VIEWS = {"view_attacks_by_time": view_attacks_by_time, "view_daily_attacks": view_daily_attacks} | {n: _report(n) for n in views.BUCKET_REPORTS}


def register_views(spark: SparkSession, root: str, as_of=None, tz: str | None = None, table: str = "attacks") -> dict[str, DataFrame]:
    """Register the views over the minute counts as temporary views. They show the store
    as it is at this call; register again after a refresh."""
    out = {name: fn(spark, root, as_of=as_of, tz=tz, table=table) for name, fn in VIEWS.items()}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out
