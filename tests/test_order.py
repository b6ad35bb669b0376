"""Ordering and limits of the views (the driver's check ignores order)."""

from trapline.plans import views


def _attacks(spark, rows):
    data = [(i + 1, ts, src, "d", u, p, "ssh", "e") for i, (ts, src, u, p) in enumerate(rows)]
    return spark.createDataFrame(
        data, "id long, timestamp long, source_ip string, destination_ip string, username string, "
        "password string, attack_type string, evidence string")


def test_count_desc_then_key(spark):
    a = _attacks(spark, [(1000 * i, "s", u, "p") for i, u in enumerate(["b", "a", "c", "c", "B"])])
    got = [(r["username"], r["count"]) for r in views.view_usernames(a).collect()]
    assert got == [("c", 2), ("B", 1), ("a", 1), ("b", 1)]  # binary order: upper case first


def test_top_20_ties_break_on_key(spark):
    now = 1706659200000
    rows = [(now - 1000, f"s{i:02d}", "u", "p") for i in range(25)]
    a = _attacks(spark, rows)
    got = [r["source_ip"] for r in views.report_top_attackers_last_24_hours(a, as_of=now // 1000).collect()]
    assert got == [f"s{i:02d}" for i in range(20)]


def test_view_log_newest_first_ties_by_id(spark):
    a = _attacks(spark, [(5000, "a", "u", "p"), (9000, "b", "u", "p"), (5000, "c", "u", "p")])
    assert [r["source"] for r in views.view_log(a, tz="UTC").collect()] == ["b", "c", "a"]


def test_fingerprint_order_and_list(spark):
    a = _attacks(spark, [(1000, "z", "u1", "p"), (2000, "a", "u1", "p"), (3000, "m", "u2", "p"), (4000, "m", "u2", "p")])
    got = views.view_credential_fingerprints(a, tz="UTC").collect()
    assert [(r["username"], r["distinct_source_ips"], r["total_uses"], r["source_ips"]) for r in got] == [
        ("u2", 1, 2, "m"), ("u1", 2, 2, "a,z")]


def test_by_time_ascending(spark):
    a = _attacks(spark, [(120000, "a", "u", "p"), (0, "a", "u", "p"), (3600000, "a", "u", "p")])
    got = [(r["hour_of_day"], r["minute_of_hour"]) for r in views.view_attacks_by_time(a, tz="UTC").collect()]
    assert got == [("00", "00"), ("00", "02"), ("01", "00")]


def test_new_fingerprints_need_single_source_ever(spark):
    now = 1706659200
    a = _attacks(spark, [
        ((now - 30 * 86400) * 1000, "x", "old", "p"),   # first seen long ago
        ((now - 86400) * 1000, "x", "new", "p"),        # single source, recent
        ((now - 86400) * 1000, "x", "two", "p"),
        ((now - 86400) * 1000, "y", "two", "p"),        # two sources
    ])
    got = [(r["username"], r["source_ips"]) for r in
           views.report_new_credential_fingerprints_last_7_days(a, as_of=now, tz="UTC").collect()]
    assert got == [("new", "x")]


def test_source_list_order_across_prefix_parts(spark):
    ips = ["1.2.3.4", "1.2.3.45", "10.0.0.1", "1.2.30.1", "9.9.9.9", "100.1.1.1", "1", "1.2", "::1", "fe80::1",
           "1.2.3.4"]
    a = _attacks(spark, [(1000 * i, ip, "u", "p") for i, ip in enumerate(ips)])
    r = views.view_credential_fingerprints(a, tz="UTC").first()
    assert r["source_ips"] == ",".join(sorted(set(ips)))
    assert r["distinct_source_ips"] == len(set(ips)) and r["total_uses"] == len(ips)
