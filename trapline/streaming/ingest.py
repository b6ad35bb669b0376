"""Continuous ingest with exact dedup against all stored history.

    readStream (raw requests or bodies)
      -> foreachBatch:
           route + decode + clean                  (sources.submissions)
           dedup inside the batch, first arrival wins
           anti-join against stored rows of the batch's days only
           [coded store: look up and extend dictionaries, encode once, anti-join on ids]
           number the new rows above all ids given out so far, in order of
           arrival, and append them
           (rejected bodies and log lines go to tables of their own)

Exact over unbounded history without unbounded state: time is part of the
uniqueness key, so a duplicate can only sit in the same UTC day folder as the
new row. The batch's days prune the folders that are read, its times the parts
of their files; records without a time, which all share one, lie in buckets of
their key, of which only the batch's are read. So the work per batch follows the
batch, not the history. A row's number comes from its place in the input, so
nothing is sorted, staged or checkpointed for it.

Restarts lose and repeat nothing. Re-running a batch (after a failure, or the
same input under a new checkpoint) adds nothing: the anti-join finds the rows a
previous attempt wrote. Ids are reserved before rows are written, so no id is
given twice; there is no limit to a batch's rows or partitions or to the number
of batches. Rejected bodies and log lines are kept per run (a checkpoint's
token) and batch: a rerun of a batch replaces its own rejected bodies with the
same ones and keeps its log, another run never touches them. Dictionaries are
appended before fact rows; unused ids are harmless.

The exact form uses no watermark: one on the records' own time would drop records
that arrive later than its delay, while the original accepts late and
future-dated records without limit.

``start_bounded_ingest`` is the form with bounded state for sensors that resend
soon or never. It reads no history: Spark's state store keeps the keys that
arrived within ``horizon``, and a repeat that arrives later is stored again. The
watermark is on arrival, not on the records' own time, so late and future-dated
records are accepted without limit here too.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, dictionary
from ..operators.filters import only_submissions
from ..plans import rollup
from ..schema import KEY7, TEXT_COLUMNS
from ..functions.text import log_line
from ..sources import store
from ..sources.submissions import clean, decode_tagged, split


#: Spark numbers rows as partition and place; the place takes so many bits
_PART_BITS = 33
#: distinct days of a batch that are broadcast (10 bytes of text each)
DAY_LIST = 100_000


def _arrival_ids(df: DataFrame) -> DataFrame:
    """Arrival number in input order (stable for a replayed file split)."""
    return df.withColumn("_arrival", F.monotonically_increasing_id())


def _dealt(batch: DataFrame) -> DataFrame:
    """Numbered rows, dealt by their arrival number to all tasks. A source may come in a few
    large splits (a Parquet file is split at row groups only), and decoding is most of the work."""
    return batch.repartition(int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_arrival")


def _first_numbers(parts: list) -> tuple[Column, int]:
    """The number of each row's first fellow of its input partition, and how many numbers all need.

    ``parts`` has a row for each input partition: its number and the last arrival in it."""
    starts, total = [F.lit(0).cast("long")], 0
    for r in sorted(parts, key=lambda r: r["part"]):
        starts += [F.lit(total).cast("long")] * (r["part"] + 1 - len(starts))
        total += r["last"] - (r["part"] << _PART_BITS) + 1
        starts.append(F.lit(total).cast("long"))
    return F.get(F.array(*starts), F.shiftright("_arrival", _PART_BITS).cast("int")), total


def _numbered(rows: DataFrame, parts: list, first: int) -> DataFrame:
    """``rows`` with ids from ``first`` on, in order of arrival. A row that is dropped leaves its id out."""
    start, _ = _first_numbers(parts)
    at = F.col("_arrival").bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    return rows.withColumn("id", F.lit(first) + start + at)


def _history(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored rows that ``rows`` may repeat; other folders, and files of other times, are not read.

    A repeat has the time of its first. The batch's days choose day folders, and its
    least and greatest time what is read of them. Up to ``DAY_LIST`` days are broadcast;
    more, of a batch all over the calendar, are joined by size as any table. Rows
    without a time choose buckets of theirs, ``store.BUCKETS`` at most."""
    day, bucket = F.col(store.DATE_COL), F.col(store.BUCKET_COL)
    zero = store.is_zero_day(day)
    placed = store.with_place(rows)
    time = F.when(~zero, F.col("timestamp"))
    seen = placed.agg(F.count_distinct(F.when(~zero, day)).alias("days"), F.min(time).alias("lo"), F.max(time).alias("hi"), F.collect_set(F.when(zero, bucket)).alias("buckets")).first()
    kept = stored.filter(zero & bucket.isin(seen["buckets"])) if store.BUCKET_COL in stored.columns else stored.filter(zero)
    if not seen["days"]:
        return kept
    days = placed.filter(~zero).select(store.DATE_COL).distinct()
    days = F.broadcast(days) if seen["days"] <= DAY_LIST else days
    dated = stored.filter(F.col("timestamp").between(seen["lo"], seen["hi"])).join(days, store.DATE_COL, "left_semi")
    return dated.unionByName(kept) if seen["buckets"] else dated


#: Hadoop's setting of the marker of a whole write
_MARK = "mapreduce.fileoutputcommitter.marksuccessfuljobs"


def _write_log(rows_new: DataFrame, path: str, tz: str | None) -> None:
    """One text line per newly stored record. It is written before the rows
    are stored; once its marker is there it is whole, and a rerun leaves it. A
    folder without one is of a write that was cut off, and is written again."""
    if not store.path_exists(rows_new.sparkSession, f"{path}/_SUCCESS"):
        line = log_line("timestamp", "source_ip", "username", "password", tz=tz).alias("value")
        rows_new.orderBy("id").select(line).write.mode("overwrite").option(_MARK, "true").text(path)


def process_batch(batch: DataFrame, batch_id: int, root: str, tz: str | None = None,
                  coded: bool = False, log_lines: bool = False, run: str = "batch", minutes: bool = False) -> None:
    """Handle one micro-batch (also usable on a plain batch DataFrame). ``run``
    names the sequence of batches that ``batch_id`` counts. With ``log_lines``,
    the records stored by this batch are also written as readable lines to
    ``<root>/log/run=<run>/batch_id=N``. With ``minutes``, the counts per minute
    (``plans.rollup``) are brought up to date after it."""
    spark = batch.sparkSession
    batch = _arrival_ids(batch)
    if "method" in batch.columns and "path" in batch.columns:
        batch = only_submissions(batch).drop("method", "path")
    place = f"run={run}/batch_id={batch_id}"
    # decode once; accepted and rejected rows are both read from this copy, which
    # keeps the bodies of rejected rows only
    tagged = decode_tagged(_dealt(batch), tz=tz)
    tagged = tagged.withColumn("body", F.when(F.col("reason").isNotNull(), F.col("body"))).persist(StorageLevel.MEMORY_AND_DISK)
    kept = [tagged]
    try:
        accepted, rejected = split(tagged)
        part = F.shiftright("_arrival", _PART_BITS).cast("int").alias("part")
        counts = [F.max("_arrival").alias("last"), F.count("reason").alias("rejected"), F.count(F.lit(1)).alias("n")]
        parts = tagged.groupBy(part).agg(*counts).collect()  # a row for each input partition
        n_rejected = sum(r["rejected"] for r in parts)
        if n_rejected:
            rejected.drop("_arrival").write.mode("overwrite").parquet(f"{root}/rejected/{place}")
        if n_rejected == sum(r["n"] for r in parts):
            return
        rows = dedup.dedup_keep_first(clean(accepted).select("_arrival", *KEY7), KEY7, "_arrival")
        table, dicts = "attacks", None
        if coded:
            table, dicts = "fact", _batch_dictionaries(spark, rows, root, kept)
            rows = dictionary.encode(rows, dicts)  # from here on all is done on ids
        kept.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
        if store.table_exists(spark, root, table):
            stored = store.read_fact(spark, root, buckets=True) if coded else store.read_attacks(spark, root, buckets=True)
            rows = dedup.drop_seen(rows, _history(stored, rows), KEY7)
        numbers = _first_numbers(parts)[1]
        rows = _numbered(rows, parts, store.reserve_ids(spark, root, numbers))
        if log_lines:
            kept.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
            shown = dictionary.decode(rows, dicts, ["source_ip", "username", "password"]) if coded else rows
            _write_log(shown, f"{root}/log/{place}", tz)
        (store.write_fact if coded else store.write_attacks)(rows, root, "append", batch_rows=numbers)
        if minutes:
            rollup.refresh(spark, root, tz, table)
    finally:
        for df in kept:
            df.unpersist()


def _append_batch(rows: DataFrame, batch_id: int, root: str, run: str) -> None:
    """Number and append the rows of a micro-batch that its state let through.

    The mark of a begun batch is written before, that of a finished one after its
    rows. A rerun of a batch that was begun and not finished may find rows of its
    own, and looks for them in the history; other batches need not."""
    spark = rows.sparkSession
    begun, done = (f"{root}/bounded/run={run}/batch_id={batch_id}/{x}" for x in ("begun", "done"))
    if store.path_exists(spark, f"{done}/_SUCCESS"):
        return
    rows = _arrival_ids(rows.select(*KEY7)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        parts = rows.groupBy(F.shiftright("_arrival", _PART_BITS).cast("int").alias("part")).agg(F.max("_arrival").alias("last")).collect()
        if not parts:
            return
        new = rows
        if store.path_exists(spark, f"{begun}/_SUCCESS") and store.table_exists(spark, root, "attacks"):
            new = dedup.drop_seen(rows, _history(store.read_attacks(spark, root, buckets=True), rows), KEY7)
        mark = spark.range(1).selectExpr("CAST(id AS STRING) AS value").coalesce(1).write.mode("overwrite").option(_MARK, "true")
        mark.text(begun)
        numbers = _first_numbers(parts)[1]
        new = _numbered(new, parts, store.reserve_ids(spark, root, numbers))
        store.write_attacks(new, root, "append", batch_rows=numbers)
        mark.text(done)
    finally:
        rows.unpersist()


def start_bounded_ingest(source: DataFrame, root: str, horizon: str = "1 day", arrival: str | None = None,
                         checkpoint: str | None = None, tz: str | None = None,
                         available_now: bool = True, processing_time: str | None = None):
    """Start the ingest with bounded state; returns its two queries (stored rows,
    and rejected bodies, which go to ``<root>/rejected_stream``).

    A record is dropped if an equal one arrived at most ``horizon`` before it. A
    repeat that arrives later is stored once more, as soon as the watermark has
    passed the first one's arrival by ``horizon``. ``arrival`` names a TIMESTAMP
    column of ``source`` (default: the time a batch is taken); rows whose arrival
    lies more than ``horizon`` behind the latest one seen are dropped, so it should
    be a clock of the receiver's, not of the sensor's. Ids are unique and grow from
    batch to batch; within one they follow the state store, not arrival."""
    checkpoint = (checkpoint or f"{root.rstrip('/')}/_checkpoint").rstrip("/")
    run = _run_token(source.sparkSession, checkpoint)
    if "method" in source.columns and "path" in source.columns:
        source = only_submissions(source).drop("method", "path")
    source = source.withColumn("_arrived", F.col(arrival) if arrival else F.current_timestamp())
    # to all tasks, as in ``_dealt``
    source = source.repartition(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    accepted, rejected = split(decode_tagged(source, tz=tz))
    rows = dedup.dedup_within(clean(accepted).select("_arrived", *KEY7), "_arrived", horizon)
    trigger = {"processingTime": processing_time} if processing_time else {"availableNow": available_now}
    kept = rows.writeStream.foreachBatch(lambda df, bid: _append_batch(df, bid, root, run)).option("checkpointLocation", f"{checkpoint}/rows").trigger(**trigger).start()
    rejected = rejected.drop("_arrived") if arrival else rejected.withColumnRenamed("_arrived", "arrived")
    bad = (
        rejected.writeStream.format("parquet").option("path", f"{root}/rejected_stream")
        .option("checkpointLocation", f"{checkpoint}/rejected").trigger(**trigger).start()
    )
    return kept, bad


def _batch_dictionaries(spark: SparkSession, rows: DataFrame, root: str, kept: list) -> dict[str, DataFrame]:
    """The dictionary entries of a batch's values; new ones are added to the stored
    dictionaries (one write for all six; unused ids after a failure are harmless).

    The stored dictionaries are read to look up the batch's values, and once more if
    some were new. What the rows are joined with are the entries found, so it grows
    with the batch alone."""
    values = dictionary.stacked_values(rows, TEXT_COLUMNS).persist(StorageLevel.MEMORY_AND_DISK)
    kept.append(values)

    def found() -> DataFrame:
        return dictionary.known_entries(store.read_stacked_dictionaries(spark, root), values)

    new = values
    if store.table_exists(spark, root, "dict"):
        new = values.join(found().select("column", "value"), ["column", "value"], "left_anti")
    new = new.persist(StorageLevel.MEMORY_AND_DISK)
    counts = {r["column"]: r["n"] for r in new.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts:
        starts = store.reserve_entries(spark, root, counts)
        fresh = dictionary.assign_dense_ids(new, group_col="column", starts=starts)
        new.unpersist()  # a write to a folder makes Spark work out again what is cached of it
        store.write_dictionaries(fresh, root, "append", reserved=True)
    else:
        new.unpersist()
    entries = found().persist(StorageLevel.MEMORY_AND_DISK)
    kept.append(entries)
    return dictionary.split_stacked(entries)


def _run_token(spark: SparkSession, checkpoint: str) -> str:
    """The name of the runs that share a checkpoint; kept inside it."""
    path = f"{checkpoint.rstrip('/')}/ingest_run"
    if not store.path_exists(spark, path):
        spark.createDataFrame([(uuid.uuid4().hex[:12],)], "value string").coalesce(1).write.text(path)
    return spark.read.text(path).first()["value"]


def start_ingest(source: DataFrame, root: str, checkpoint: str | None = None, tz: str | None = None,
                 coded: bool = False, available_now: bool = True, processing_time: str | None = None,
                 query_name: str | None = None, log_lines: bool = False, minutes: bool = False):
    """Start the exact ingest stream. ``source`` is a streaming DataFrame of
    raw bodies (column ``body``) or requests (``method``, ``path``, ``body``).
    The checkpoint defaults to a folder of the store itself, so that a
    restarted application goes on where the last one stopped."""
    spark = source.sparkSession
    if checkpoint is None:
        checkpoint = f"{root.rstrip('/')}/_checkpoint"
    run = _run_token(spark, checkpoint)
    writer = source.writeStream.foreachBatch(
        lambda df, bid: process_batch(df, bid, root, tz, coded, log_lines, run, minutes)
    ).option("checkpointLocation", checkpoint)
    if query_name:
        writer = writer.queryName(query_name)
    if available_now and not processing_time:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
