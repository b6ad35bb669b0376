"""Reports without a fixed time end at the time of each read; coded `attacks`."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from trapline.functions import timefn as T
from trapline.operators import dictionary
from trapline.plans import coded_views, views
from trapline.session import scratch_path
from trapline.sources import derived, store


def _shifted(spark):
    """The attacks moved so that the last one was an hour ago."""
    a = derived.attack_records(spark, SF_SMALL).checkpoint()
    last = a.agg(F.max("timestamp")).first()[0]
    import time

    return a.withColumn("timestamp", F.col("timestamp") + F.lit(int(time.time() * 1000) - 3_600_000 - last))


def test_plan_holds_the_current_time_and_prunes_folders(spark):
    root = scratch_path(spark, "live")
    store.write_attacks(_shifted(spark), root, "overwrite")
    found = views.register_views(spark, store.read_attacks(spark, root), tz="UTC")
    df = found["report_top_attackers_last_24_hours"]
    assert "current_timestamp()" in df._jdf.queryExecution().analyzed().toString()
    plan = spark.sql("SELECT * FROM report_top_attackers_last_24_hours")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((date" in plan and "GreaterThanOrEqual(timestamp," in plan
    fixed = views.report_top_attackers_last_24_hours(store.read_attacks(spark, root), as_of=T.as_of_seconds(None))
    assert df.collect() == fixed.collect() and df.count() > 0


def test_coded_store_has_twenty_one_views(spark):
    attacks = _shifted(spark)
    dicts = dictionary.build_dictionaries(attacks)
    found = coded_views.register_coded_views(spark, dictionary.encode(attacks, dicts), dicts, tz="UTC")
    assert len(found) == 21
    assert spark.sql("SELECT count(*) FROM attacks").first()[0] == attacks.count()
    assert spark.sql("SELECT * FROM report_top_logins_last_7_days").count() == 20


def test_patterns_count_logins_by_their_text(spark):
    """Two pairs with one joined text are one login; no row is expanded."""
    sep = " <-| username @ password |-> "
    pairs = [("a", "b"), ("a", "c"), ("x", "<-| username @ password |-> y"), ("x <-| username @ password |->", "y"), ("p" + sep, "q"), (None, "b"), ("a", None)]
    rows = [(i, 1704164645000 + i, "s", "d", u, p, "t", "e") for i, (u, p) in enumerate(pairs * 2)]
    a = spark.createDataFrame(rows, "id long, timestamp long, source_ip string, destination_ip string, username string, password string, attack_type string, evidence string")
    df = views.view_attack_patterns_by_source(a, tz="UTC")
    texts = {u + sep + p for u, p in pairs if u is not None and p is not None}
    r = df.first()
    assert (r["total_attacks"], r["unique_usernames"], r["unique_passwords"], r["unique_logins"]) == (14, 4, 5, len(texts)) and len(texts) == 4
    assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()


def test_offsets_up_to_a_day(spark):
    texts = ["2024-01-02T00:00:00+18:30", "2024-01-02T00:00:00-23:00", "2024-01-02T00:00:00+24:00", "2024-01-02T00:00:00+25:00", "2024-01-02T00:00:00+01:61", "2024-01-02T00:00:00.5Z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    base = 1704153600000
    got = [r[0] for r in df.select(T.parse_flexible_time("t", "UTC")).collect()]
    assert got == [base - 66_600_000, base + 82_800_000, base - 86_400_000, None, None, base + 500]
