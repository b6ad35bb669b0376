"""Stored tables: decoded attacks, coded fact + dictionaries, legacy table.

Layout at rest (parquet):

  <root>/attacks/date=YYYY-MM-DD/bucket=B/...   decoded attacks, one folder per UTC day
  <root>/fact/date=YYYY-MM-DD/bucket=B/...      coded fact rows (ids)
  <root>/dict/column=<name>/...        six dictionaries (id, value), one table

  <root>/id_mark/...                   the largest id given out by the ingest
  <root>/dict_mark/...                 the same for each dictionary
  <root>/minutes/...                   counts per local minute (``plans.rollup``)
  <root>/generation/...                a row for each batch write since the first of those

Rows are range-partitioned on (date, timestamp, source, ...) before the write,
so a busy day, or a third of all rows at one instant, is split over many tasks
and every file covers a narrow time span: the parquet min/max statistics then
let ``timestamp >= cut`` skip row groups, and ``date >= ...`` (added by
``operators.filters.since``) skips folders. Times outside years 0000 to 9999
have no date and go to Spark's default partition.

Records without a time all share the zero time, so their day may hold any share
of the rows. That day, and the rows without a date, are dealt into ``BUCKETS``
folders by a hash of the whole key; every other day is one bucket, 0. A row's
bucket follows from the row, so equal rows meet in one folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..operators.filters import utc_date_text
from ..schema import ATTACKS, DICT, FACT, KEY7, LEGACY, TEXT_COLUMNS

DATE_COL, BUCKET_COL = "date", "bucket"
#: the day of records without a time, and the folders it is dealt into
ZERO_DAY, BUCKETS = "0001-01-01", 16
#: rows of a batch for which a folder gets one more file
FILE_ROWS = 4_000_000
MARK = StructType([StructField("top", LongType())])


def is_zero_day(day: Column) -> Column:
    """Whether rows of a day are dealt by key: the zero time's day, and no day."""
    return F.coalesce(day, F.lit(ZERO_DAY)) == ZERO_DAY


def with_place(df: DataFrame) -> DataFrame:
    """``df`` (rows with KEY7) with its date and bucket."""
    day = utc_date_text("timestamp")
    dealt = F.pmod(F.xxhash64(*KEY7), F.lit(BUCKETS)).cast("int")
    return df.withColumns({DATE_COL: day, BUCKET_COL: F.when(is_zero_day(day), dealt).otherwise(0)})


def _layout(df: DataFrame) -> DataFrame:
    """Ranges of time, then of source and credential: rows of one instant
    spread too. No fixed number: adaptive execution joins small ranges, so a
    small batch writes few files."""
    order = [DATE_COL, BUCKET_COL, "timestamp", "source_ip", "username", "password", "id"]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def _batch_layout(df: DataFrame, rows: int) -> DataFrame:
    """A batch's rows, whose times lie close together as they are: dealt by folder
    to all tasks, a folder of a large batch to several, and sorted by time. No
    range sample, so the batch is worked out once."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64(*KEY7, F.lit(1)), F.lit(1 + rows // FILE_ROWS))
    return df.repartition(parts, DATE_COL, BUCKET_COL, share).sortWithinPartitions(DATE_COL, BUCKET_COL, "timestamp")


def _write(rows: DataFrame, path: str, mode: str, batch_rows: int | None) -> None:
    placed = with_place(rows)
    placed = _layout(placed) if batch_rows is None else _batch_layout(placed, batch_rows)
    placed.write.mode(mode).partitionBy(DATE_COL, BUCKET_COL).parquet(path)


def _append_ids(df: DataFrame, root: str) -> None:
    """Forget the id mark: rows with ids of their own are about to come in."""
    if table_exists(df.sparkSession, root, "id_mark"):
        _write_mark(df.sparkSession, root, [])
    if path_exists(df.sparkSession, f"{root}/minutes"):
        begin_generation(df.sparkSession, root)


def generation(spark: SparkSession, root: str) -> int:
    """How often rows with ids of their own came into a store that had minute counts."""
    return spark.read.schema(MARK).parquet(f"{root}/generation").count() if path_exists(spark, f"{root}/generation") else 0


def begin_generation(spark: SparkSession, root: str) -> None:
    """Minute counts kept so far hold no longer."""
    spark.createDataFrame([(None,)], MARK).coalesce(1).write.mode("append").parquet(f"{root}/generation")


def _write_mark(spark: SparkSession, root: str, rows: list) -> None:
    spark.createDataFrame(rows, MARK).coalesce(1).write.mode("overwrite").parquet(f"{root}/id_mark")


def reserve_ids(spark: SparkSession, root: str, count: int) -> int:
    """The first of ``count`` ids that nothing in the store has or will get.

    The mark is kept in a one-row table and written before the rows, so ids of
    a batch that fails are skipped, never given twice. Without a mark (a store
    built or appended to by a batch write) the stored ids are looked through
    once. One ingest at a time writes to a store."""
    top = None
    if table_exists(spark, root, "id_mark"):
        top = spark.read.schema(MARK).parquet(f"{root}/id_mark").agg(F.max("top")).first()[0]
    if top is None:
        found = [spark.read.schema(ATTACKS).parquet(f"{root}/{t}").agg(F.max("id")).first()[0] for t in ("attacks", "fact") if table_exists(spark, root, t)]
        top = max([0, *(x for x in found if x is not None)])
    _write_mark(spark, root, [(top + count,)])
    return top + 1


def write_attacks(attacks: DataFrame, root: str, mode: str = "append", batch_rows: int | None = None) -> None:
    """Write decoded attacks (id, timestamp, six text columns). ``batch_rows``: they are a
    batch of the ingest, of so many rows at most, with ids above the mark."""
    if batch_rows is None:
        _append_ids(attacks, root)
    _write(attacks.select(*ATTACKS.fieldNames()), f"{root}/attacks", mode, batch_rows)


def _partitioned(schema: StructType) -> StructType:
    return StructType(schema.fields + [StructField(DATE_COL, StringType()), StructField(BUCKET_COL, IntegerType())])


def read_attacks(spark: SparkSession, root: str, streaming: bool = False, buckets: bool = False) -> DataFrame:
    """Decoded attacks with their ``date`` partition column (and ``bucket``, if asked for)."""
    reader = spark.readStream if streaming else spark.read
    found = reader.schema(_partitioned(ATTACKS)).parquet(f"{root}/attacks")
    return found if buckets else found.drop(BUCKET_COL)


DICT_STACKED = StructType(DICT.fields + [StructField("column", StringType())])


#: the largest id given out in each dictionary
DICT_MARK = StructType([StructField("column", StringType()), StructField("top", LongType())])


def _write_dict_mark(spark: SparkSession, root: str, tops: dict[str, int]) -> None:
    spark.createDataFrame(sorted(tops.items()), DICT_MARK).coalesce(1).write.mode("overwrite").parquet(f"{root}/dict_mark")


def reserve_entries(spark: SparkSession, root: str, counts: dict[str, int]) -> dict[str, int]:
    """For each dictionary the id above which ``counts[column]`` ids are free and will not be given again.

    As ``reserve_ids``: the marks, a row a column, are written before the entries;
    without marks the stored entries are looked through once."""
    tops = {}
    if path_exists(spark, f"{root}/dict_mark"):
        tops = {r["column"]: r["top"] for r in spark.read.schema(DICT_MARK).parquet(f"{root}/dict_mark").collect()}
    if not tops and table_exists(spark, root, "dict"):
        tops = {r["column"]: r["top"] for r in read_stacked_dictionaries(spark, root).groupBy("column").agg(F.max("id").alias("top")).collect()}
    tops = {c: tops.get(c, 0) for c in {*tops, *counts}}
    _write_dict_mark(spark, root, {c: top + counts.get(c, 0) for c, top in tops.items()})
    return tops


def write_dictionaries(dicts, root: str, mode: str = "append", reserved: bool = False) -> None:
    """Write dictionaries: a ``{column: (id, value)}`` dict or the stacked
    ``(column, id, value)`` frame; one job, one folder per column. ``reserved``: their
    ids are from ``reserve_entries``; others make the marks void."""
    if isinstance(dicts, dict):
        from ..operators.dictionary import stack_dictionaries

        dicts = stack_dictionaries(dicts)
    spark = dicts.sparkSession
    if not reserved and path_exists(spark, f"{root}/dict_mark"):
        _write_dict_mark(spark, root, {})
    # few files a column, more only where there are bytes for them
    dicts.select("id", "value", "column").hint("rebalance", "column").write.mode(mode).partitionBy("column").parquet(f"{root}/dict")


def read_stacked_dictionaries(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(DICT_STACKED).parquet(f"{root}/dict")


def read_dictionaries(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """``{column: (id, value)}``; each is a partition-pruned scan."""
    stacked = read_stacked_dictionaries(spark, root)
    return {c: stacked.filter(stacked["column"] == c).select("id", "value") for c in TEXT_COLUMNS}


def write_fact(fact: DataFrame, root: str, mode: str = "append", batch_rows: int | None = None) -> None:
    """Write coded rows (id, timestamp, six dictionary ids)."""
    if batch_rows is None:
        _append_ids(fact, root)
    _write(fact.select(*FACT.fieldNames()), f"{root}/fact", mode, batch_rows)


def read_fact(spark: SparkSession, root: str, buckets: bool = False) -> DataFrame:
    found = spark.read.schema(_partitioned(FACT)).parquet(f"{root}/fact")
    return found if buckets else found.drop(BUCKET_COL)


def read_coded(spark: SparkSession, root: str):
    """(fact, dictionaries) of a coded store."""
    return read_fact(spark, root), read_dictionaries(spark, root)


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """The flat first-generation table (parquet export; a database file can
    be read with Spark's JDBC source into the same schema)."""
    return spark.read.schema(LEGACY).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when there is something at ``path``. Anything but a missing path is an error."""
    try:
        spark.read.text(path)
        return True
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def table_exists(spark: SparkSession, root: str, table: str) -> bool:
    """True when ``<root>/<table>`` is there. Anything but a missing path is an
    error: taking it for an empty history would store duplicates."""
    try:
        spark.read.schema(DICT_STACKED if table == "dict" else _partitioned(ATTACKS)).parquet(f"{root}/{table}")
        return True
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


__all__ = [
    "write_attacks",
    "read_attacks",
    "write_dictionaries",
    "read_dictionaries",
    "read_stacked_dictionaries",
    "write_fact",
    "read_fact",
    "read_coded",
    "read_legacy",
    "table_exists",
    "path_exists",
    "generation",
    "begin_generation",
    "reserve_ids",
    "reserve_entries",
]
