"""Sources and SQL access: raw text bodies, stored layout, registered views."""


from conftest import SF_SMALL
from trapline.plans import catalog, views
from trapline.session import scratch_path
from trapline.sources import derived, store, submissions


def test_text_bodies_round_trip(spark):
    path = scratch_path(spark, "test-bodies")
    bodies = ['{"source_ip":"1.1.1.1","username":"root","attack_timestamp":"2024-01-02T03:04:05Z"}', "{broken", "null"]
    spark.createDataFrame([(b,) for b in bodies], "value string").coalesce(1).write.text(path)
    df = submissions.read_submissions(spark, path, fmt="text")
    acc, rej = submissions.decode(df, tz="UTC")
    got = sorted((r["source_ip"], r["username"], r["timestamp"]) for r in acc.collect())
    assert got == [("", "", -62135596800000), ("1.1.1.1", "root", 1704164645000)]
    assert [r["reason"] for r in rej.collect()] == ["not_json_object"]


def test_store_layout_prunes_days(spark):
    root = scratch_path(spark, "test-store-layout")
    attacks = derived.attack_records(spark, SF_SMALL)
    store.write_attacks(attacks, root, "overwrite")
    back = store.read_attacks(spark, root)
    assert back.count() == attacks.count()
    recent = views.report_top_attackers_last_24_hours(back, as_of=catalog.AS_OF)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    # folders before the cut are skipped; times without a date are kept
    assert "PartitionFilters: [((date" in plan and ">= 2024-01-29)" in plan and "isnull(date" in plan
    assert "GreaterThanOrEqual(timestamp,1706572800000)" in plan
    assert "ReadSchema: struct<timestamp:bigint,source_ip:string>" in plan
    assert recent.count() > 0


def test_register_views_allows_sql(spark):
    attacks = derived.attack_records(spark, SF_SMALL)
    views.register_views(spark, attacks, as_of=catalog.AS_OF, tz="UTC")
    n = spark.sql("SELECT count(*) AS n FROM view_usernames").first()["n"]
    assert n == attacks.select("username").distinct().count()
    top = spark.sql("SELECT * FROM report_top_logins_last_7_days").collect()
    assert len(top) == 20
