"""Minute counts kept beside the store equal the views over its rows."""

import pytest
from pyspark.sql import functions as F

from trapline.plans import rollup, views
from trapline.schema import KEY7
from trapline.session import scratch_path
from trapline.sources import store
from trapline.streaming import ingest

AS_OF = "2024-03-31T12:00:00+00:00"
ZONE = "Europe/Berlin"


def _bodies(spark, first, n):
    # a step of 37 minutes over the clock change of 31 March; every tenth record has no time
    body = F.format_string('{"source_ip":"10.0.0.%d","username":"u%d","password":"p"', F.col("id") % 7, F.col("id"))
    at = F.date_format(F.timestamp_seconds(1711800000 + F.col("id") * 37 * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    timed = F.concat(body, F.lit(',"attack_timestamp":"'), at, F.lit('"}'))
    return spark.range(first, first + n, 1, 2).select(F.when(F.col("id") % 10 == 3, F.concat(body, F.lit("}"))).otherwise(timed).alias("body"))


def _arrive(spark, root, first, n):
    """A batch of the ingest: ids above all earlier ones."""
    rows = _rows(spark, first, n).withColumn("id", F.col("id") - first + store.reserve_ids(spark, root, n) - 1)
    store.write_attacks(rows, root, "append", batch_rows=n)


def _rows(spark, first, n):
    return spark.range(first, first + n).selectExpr(
        "id + 1 AS id", "1711800000000 + id * 61000 AS timestamp", "'s' AS source_ip", "'d' AS destination_ip", "CAST(id AS STRING) AS username", "'p' AS password", "'t' AS attack_type", "'e' AS evidence")


def _equal(spark, root, tz=ZONE, table="attacks"):
    rows = store.read_fact(spark, root) if table == "fact" else store.read_attacks(spark, root)
    for name, fn in rollup.VIEWS.items():
        got = fn(spark, root, as_of=AS_OF, tz=tz, table=table).collect()
        assert got == views.build_view(name, rows, as_of=AS_OF, tz=tz).collect(), name


@pytest.mark.parametrize("coded", [False, True])
def test_counts_follow_the_ingest_over_reruns_and_gaps(spark, coded):
    root, table = scratch_path(spark, "test-minutes"), "fact" if coded else "attacks"
    for k in (0, 1, 1):  # the second batch twice
        ingest.process_batch(_bodies(spark, 40 * k, 60), k, root, tz=ZONE, coded=coded, minutes=True)
    ingest.process_batch(_bodies(spark, 80, 50), 2, root, tz=ZONE, coded=coded)  # not covered
    assert sum(r["count"] for r in rollup.minute_counts(spark, root, ZONE, table).collect()) == 130
    _equal(spark, root, table=table)
    rollup.refresh(spark, root, ZONE, table)
    _equal(spark, root, table=table)
    if not coded:
        _equal(spark, root, tz="UTC")  # a zone without counts


def test_a_refresh_reads_new_rows_only_and_merges(spark, monkeypatch):
    monkeypatch.setattr(rollup, "MERGE_AT", 2)
    seen = []
    counted = views.minute_counts
    monkeypatch.setattr(views, "minute_counts", lambda rows, tz=None: seen.append(rows.count()) or counted(rows, tz))
    root = scratch_path(spark, "test-minutes-merge")
    for k in range(6):
        _arrive(spark, root, 20 * k, 20)
        rollup.refresh(spark, root, ZONE)
        assert len(rollup._parts(spark, rollup._home(spark, root, ZONE, "attacks"))) <= 2
    assert seen == [20] * 6
    rollup.refresh(spark, root, ZONE)
    assert seen == [20] * 6  # nothing new
    monkeypatch.undo()
    _equal(spark, root)


def test_a_lost_list_of_parts_and_a_cut_off_refresh_change_no_count(spark):
    root = scratch_path(spark, "test-minutes-lost")
    _arrive(spark, root, 0, 30)
    rollup.refresh(spark, root, ZONE)
    home = rollup._home(spark, root, ZONE, "attacks")
    # counts of a refresh that did not come to its end, in the next part's folder
    spark.createDataFrame([(0, 99)], rollup.COUNTS).write.parquet(f"{home}/1")
    _arrive(spark, root, 30, 30)
    _equal(spark, root)
    rollup.refresh(spark, root, ZONE)
    _equal(spark, root)
    spark.createDataFrame([], rollup.PARTS).write.mode("overwrite").parquet(f"{home}/parts")
    _equal(spark, root)
    rollup.refresh(spark, root, ZONE)
    _equal(spark, root)


def test_rows_with_ids_of_their_own_begin_a_new_generation(spark):
    root = scratch_path(spark, "test-minutes-batch")
    store.write_attacks(_rows(spark, 100, 50), root, "overwrite")
    rollup.refresh(spark, root, ZONE)
    null_id = _rows(spark, 20, 1).selectExpr("CAST(NULL AS LONG) AS id", *KEY7)
    store.write_attacks(_rows(spark, 0, 20).unionByName(null_id), root)  # below the ids covered
    assert store.generation(spark, root) == 1
    _equal(spark, root)
    rollup.refresh(spark, root, ZONE)
    _equal(spark, root)
    assert sum(r["count"] for r in rollup.minute_counts(spark, root, ZONE).collect()) == 71
    store.write_attacks(_rows(spark, 0, 5), root, "overwrite")
    assert sum(r["count"] for r in rollup.minute_counts(spark, root, ZONE).collect()) == 5


def test_an_empty_store_and_the_cut_off_in_the_scan(spark):
    root = scratch_path(spark, "test-minutes-empty")
    rollup.refresh(spark, root, ZONE)
    assert rollup.minute_counts(spark, root, ZONE).collect() == []
    _arrive(spark, root, 0, 30)
    rollup.refresh(spark, root, ZONE)
    report = rollup.VIEWS["report_hourly_attacks_last_7_days"](spark, root, as_of=AS_OF, tz=ZONE)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_minute," in plan and "GreaterThan(id," in plan


def test_registered_views(spark):
    root = scratch_path(spark, "test-minutes-sql")
    _arrive(spark, root, 0, 30)
    rollup.refresh(spark, root, ZONE)
    rollup.register_views(spark, root, as_of=AS_OF, tz=ZONE)
    assert spark.sql("SELECT sum(total_attacks) AS n FROM report_daily_attacks_last_90_days").first()["n"] == 30
