"""Time rules: layouts, zero time, truncation, %W / %w, clock changes."""

import datetime as dt

import pytest

from trapline.functions import timefn as T
from trapline.plans import views

ZERO = -62135596800000

CASES = [
    ("2024-01-02T03:04:05Z", 1704164645000),
    ("2024-01-02T03:04:05.123456789Z", 1704164645123),
    ("2024-01-02T03:04:05+02:00", 1704157445000),
    ("2024-01-02T03:04:05.123456", 1704164645123),
    ("2024-01-02T03:04:05", 1704164645000),
    ("1969-12-31T23:59:59.9995Z", -1),
    ("0001-01-01T00:00:00Z", ZERO),
    ("2024-01-02 03:04:05", None),
    ("2024-01-02", None),
    ("yesterday", None),
    ("", None),
    ("1700000000", None),
    ("2024-02-30T00:00:00Z", None),
    ("2024-13-01T00:00:00Z", None),
    ("2024-01-01T24:00:00Z", None),
    ("2024-01-01T00:00:60Z", None),
    ("2024-01-02T3:04:05Z", 1704164645000),
    ("2024-01-02T03:04:05,5Z", 1704164645500),
    ("2024-01-02T03:04:05,5", 1704164645500),
    ("2024-01-02T03:4:05Z", None),
    ("2024-1-02T03:04:05Z", None),
]


def test_flexible_time_layouts(spark):
    df = spark.createDataFrame([(s,) for s, _ in CASES], "s string")
    got = [r[0] for r in df.select(T.parse_flexible_time("s", "UTC")).collect()]
    assert got == [ms for _, ms in CASES]


def test_zone_less_time_uses_given_zone(spark):
    df = spark.createDataFrame([("2024-07-01T12:00:00",), ("2024-01-01T12:00:00",)], "s string")
    got = [r[0] for r in df.select(T.parse_flexible_time("s", "Europe/Berlin")).collect()]
    assert got == [1719828000000, 1704106800000]  # +02:00 in summer, +01:00 in winter


def test_seconds_truncate_toward_zero(spark):
    df = spark.createDataFrame([(-1500,), (1500,), (-1,)], "ms long")
    assert [r[0] for r in df.select(T.epoch_seconds("ms")).collect()] == [-1, 1, 0]


@pytest.mark.parametrize(
    "day,week,wday",
    [("2024-01-01", "01", "1"), ("2023-01-01", "00", "0"), ("2024-12-31", "53", "2"), ("2023-01-02", "01", "1")],
)
def test_week_of_year_and_weekday(spark, day, week, wday):
    d = dt.date.fromisoformat(day)
    df = spark.createDataFrame([(d,)], "d date")
    r = df.select(T.week_of_year_text("d"), T.weekday_text("d")).first()
    assert (r[0], r[1]) == (week, wday)


def test_week_matches_strftime_over_years(spark):
    days = [dt.date(1999, 1, 1) + dt.timedelta(days=i) for i in range(0, 12053, 7)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [(r[0], r[1]) for r in df.select(T.week_of_year_text("d"), T.weekday_text("d")).collect()]
    assert got == [(d.strftime("%W"), d.strftime("%w")) for d in days]


def _attacks(spark, stamps):
    rows = [(i + 1, ms, "1.2.3.4", "5.6.7.8", "u", "p", "ssh", "e") for i, ms in enumerate(stamps)]
    return spark.createDataFrame(
        rows, "id long, timestamp long, source_ip string, destination_ip string, username string, "
        "password string, attack_type string, evidence string")


def test_clock_change_merges_hours(spark):
    # 2024-10-27 00:30 and 01:30 UTC are both 02:30 in Berlin (clocks go back)
    a = _attacks(spark, [1729989000000, 1729992600000])
    by_time = views.view_attacks_by_time(a, tz="Europe/Berlin").collect()
    assert len(by_time) == 1 and by_time[0]["hour_of_day"] == "02" and by_time[0]["count"] == 2
    hourly = views.report_hourly_attacks_last_7_days(a, as_of="2024-10-28T00:00:00+00:00", tz="Europe/Berlin")
    r = hourly.collect()
    assert [(x["from_time"], x["to_time"], x["total_attacks"]) for x in r] == [
        ("2024-10-27 02:00:00", "2024-10-27 03:00:00", 2)
    ]


def test_local_text_ignores_session_zone(spark):
    a = _attacks(spark, [1710037800000])  # 2024-03-10 02:30 UTC
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        r = views.view_log(a, tz="UTC").first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert r["time"] == "2024-03-10 02:30:00"


def test_zero_time_formats(spark):
    a = _attacks(spark, [ZERO])
    assert views.view_log(a, tz="UTC").first()["time"] == "0001-01-01 00:00:00"


def test_cutoff_is_whole_seconds_and_open_above(spark):
    as_of = "2024-01-31T00:00:00.900+00:00"
    cut = (T.as_of_seconds(as_of) - T.SECONDS_PER_DAY) * 1000
    a = _attacks(spark, [cut - 1, cut, 1706700000000 + 86400000 * 30])  # last one after as_of
    r = views.report_top_attackers_last_24_hours(a, as_of=as_of).first()
    assert r["count"] == 2


def test_first_last_seen_are_local_text_order(spark):
    # 00:30 UTC shows 02:30 (summer time), 01:15 UTC shows 02:15 (winter time):
    # first_seen is the smaller text, which belongs to the later instant
    a = _attacks(spark, [1729989000000, 1729991700000])
    r = views.view_attack_patterns_by_source(a, tz="Europe/Berlin").first()
    assert (r["first_seen"], r["last_seen"]) == ("2024-10-27 02:15:00", "2024-10-27 02:30:00")
