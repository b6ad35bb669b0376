"""Attack-log frames derived from the driver's tables.

The driver ships TPC-H-like tables plus an ``events`` table; these functions
turn ``events`` into the shapes this engine works on. Every frame is a
projection of the whole table, so its size grows with the data.

  sensor_records   submissions as columns (one per event)
  attack_records   decoded attacks, the input of the views
  request_log      raw requests with JSON bodies (some broken on purpose)
  legacy_records   the flat table of the first storage generation
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, timefn
from ..operators import dedup, filters
from ..schema import KEY7


def read_table(spark: SparkSession, sf_dir: str, name: str, balance: bool = False) -> DataFrame:
    """A driver table; ``balance`` spreads its rows over all tasks (worth it
    only before heavy per-row work such as JSON decoding)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if balance else df


def _s(c) -> F.Column:
    return c.cast("string")


def event_millis(ts_col: str = "ts") -> F.Column:
    """Epoch ms of a TIMESTAMP_NTZ read as UTC (floor for modern dates)."""
    return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(ts_col))


def sensor_records(events: DataFrame) -> DataFrame:
    """One submission per event, as columns (before any cleaning)."""
    e, u = F.col("event_id"), F.col("user_id")
    return events.select(
        e.alias("event_id"),
        event_millis("ts").alias("timestamp"),
        F.concat(F.lit("10.0."), _s(timefn.int_div(u, 256)), F.lit("."), _s(u % 256)).alias("source_ip"),
        F.concat(F.lit("192.0.2."), _s(e % 5 + 1)).alias("destination_ip"),
        F.concat(F.lit("user"), _s(u % 37)).alias("username"),
        F.concat(F.lit("pw"), F.get_json_object("props", "$.k"), F.lit("-"), _s(e % 7)).alias("password"),
        F.col("event_type").alias("attack_type"),
        F.concat(F.lit("\t "), F.col("event_type"), F.lit(" #"), _s(e % 11), F.lit("\n")).alias("evidence"),
        (e % 100 == 99).alias("test_mode"),
    )


def with_resubmissions(records: DataFrame) -> DataFrame:
    """Sensors resend some records: every event with id ending in 3 twice.
    One scan; the copy is made by a generator, not a second read."""
    copies = F.when(F.col("event_id") % 10 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return records.withColumn("_copy", F.explode(copies)).drop("_copy")


def attack_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded attacks (id, timestamp, six text columns), unique on KEY7."""
    records = with_resubmissions(sensor_records(read_table(spark, sf_dir, "events")))
    clean = filters.drop_test(records).withColumn("evidence", text.trim_blanks("evidence"))
    clean = clean.select((F.col("event_id") + 1).alias("id"), *KEY7)
    return dedup.dedup_keep_first(clean, KEY7, "id").select("id", *KEY7)


def _iso_clock(ntz: F.Column) -> F.Column:
    """TIMESTAMP_NTZ -> 'YYYY-MM-DDTHH:MM:SS[.ffffff]' without any zone."""
    return F.translate(ntz.cast("string"), " ", "T")


def _time_spelling(e: F.Column) -> F.Column:
    """attack_timestamp text, spelled three ways by event id."""
    utc_clock = F.col("_ntz")
    zulu = F.concat(_iso_clock(utc_clock), F.lit("Z"))
    plus2 = F.concat(_iso_clock(F.timestamp_add("HOUR", F.lit(2), utc_clock)), F.lit("+02:00"))
    bare = _iso_clock(utc_clock)
    wide = F.concat(_iso_clock(F.timestamp_add("MINUTE", F.lit(23 * 60 + 30), utc_clock)), F.lit("+23:30"))
    return (
        F.when(e % 200 == 6, F.lit("yesterday"))
        .when(e % 200 == 45, wide)
        .when(e % 200 == 55, F.lit(None).cast("string"))
        .when(e % 3 == 0, zulu)
        .when(e % 3 == 1, plus2)
        .otherwise(bare)
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw requests (event_id, method, path, body) as a sensor proxy logs them.

    Bodies are JSON objects; of every 200 events residue 5 is cut short,
    residue 6 has an unreadable time, 15, 25 and 35 have text after the closing
    brace (a second object, a brace, an array's end and start), 45 has an offset
    of nearly a day and 55 no time. Zone-less times are UTC clock times.
    Residue 11 of 40 is a GET, residue 21 of 40 goes to another path.
    """
    records = with_resubmissions(sensor_records(read_table(spark, sf_dir, "events", balance=True)))
    e = F.col("event_id")
    records = records.withColumn(
        "_ntz", F.timestamp_add("MILLISECOND", F.col("timestamp"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    )
    body = F.to_json(
        F.struct(
            *[F.col(c) for c in ["source_ip", "destination_ip", "username", "password"]],
            _time_spelling(e).alias("attack_timestamp"),
            F.col("evidence"),
            F.col("attack_type"),
            F.col("test_mode"),
        )
    )
    body = (
        F.when(e % 200 == 5, F.substring(body, 1, 40))
        .when(e % 200 == 15, F.concat(body, body))
        .when(e % 200 == 25, F.concat(body, F.lit("}")))
        .when(e % 200 == 35, F.concat(body, F.lit("],["), body))
        .otherwise(body)
    )
    return records.select(
        e.alias("event_id"),
        F.when(e % 40 == 11, F.lit("GET")).otherwise(F.lit("POST")).alias("method"),
        F.when(e % 40 == 21, F.lit("/check_ip")).otherwise(F.lit("/add_attack")).alias("path"),
        body.alias("body"),
    )


def legacy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat first-generation table: untrimmed, with repeats and NULLs.

    id = 2 * event_id + 1; username NULL for residue 7 of 50; a time far beyond
    any calendar for residue 14 of 200; resubmitted rows
    (residue 3 of 10) appear again with the id that follows.
    """
    records = sensor_records(read_table(spark, sf_dir, "events"))
    e = F.col("event_id")
    base = records.select(
        (e * 2 + 1).alias("id"),
        "source_ip",
        "destination_ip",
        F.when(e % 50 == 7, F.lit(None).cast("string")).otherwise(F.col("username")).alias("username"),
        "password",
        F.when(e % 200 == 14, F.lit(9 * 10**18)).otherwise(F.col("timestamp")).alias("attack_timestamp"),
        "evidence",
        "attack_type",
        "event_id",
    )
    again = base.filter(e % 10 == 3).withColumn("id", e * 2 + 2)
    return base.unionByName(again).drop("event_id")


__all__ = [
    "read_table",
    "sensor_records",
    "with_resubmissions",
    "attack_records",
    "request_log",
    "legacy_records",
]
