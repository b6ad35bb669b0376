"""The twenty named views and reports over decoded attacks.

Every function takes the decoded attacks frame (id, timestamp, source_ip,
destination_ip, username, password, attack_type, evidence) and returns a
DataFrame with the view's columns and order. Reports that look back from
"now" take ``as_of`` (default: the current time); views that show local time
take ``tz`` (default: the session zone).

Plan shape, for scale:
  * grouping keys are the stored columns or *longs* (local day / minute /
    second numbers); text dates are made after the aggregate, on its result;
  * COUNT DISTINCTs first reduce to distinct (group, value) rows with a
    partial + final aggregate, so a source or credential holding a third of
    all rows is spread over many reducers before the per-group merge;
  * instant cut-offs are literals (``timestamp >= lit``) that reach the scan;
  * top-k reports are ``orderBy(...).limit(n)`` (TakeOrderedAndProject: a
    per-task top-k, no global sort).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timefn as T
from ..operators.filters import since, since_local
from ..schema import LOGIN_SEPARATOR

TOP_N = 20


def _count() -> F.Column:
    return F.count(F.lit(1)).alias("count")


def _with_local(attacks: DataFrame, tz, name: str = "_lsec") -> DataFrame:
    return attacks.withColumn(name, T.local_seconds_of_ms(F.col("timestamp"), tz))


# ---------------------------------------------------------------------------
# Counts by one or two columns
# ---------------------------------------------------------------------------

def _count_by(attacks: DataFrame, *keys: str) -> DataFrame:
    return (
        attacks.groupBy(*keys)
        .agg(_count())
        .orderBy(F.desc("count"), *[F.asc(k) for k in keys])
    )


def view_usernames(attacks: DataFrame, **_) -> DataFrame:
    return _count_by(attacks, "username")


def view_passwords(attacks: DataFrame, **_) -> DataFrame:
    return _count_by(attacks, "password")


def view_source_ips(attacks: DataFrame, **_) -> DataFrame:
    return _count_by(attacks, "source_ip")


def view_logins(attacks: DataFrame, **_) -> DataFrame:
    return _count_by(attacks, "username", "password")


# ---------------------------------------------------------------------------
# The log, newest first
# ---------------------------------------------------------------------------

def view_log(attacks: DataFrame, tz: str | None = None, **_) -> DataFrame:
    lsec = T.local_seconds_of_ms(F.col("timestamp"), tz)
    return attacks.orderBy(F.desc("timestamp"), F.desc("id")).select(
        T.clock_text(lsec).alias("time"),
        F.col("source_ip").alias("source"),
        "username",
        "password",
    )


# ---------------------------------------------------------------------------
# Per local day
# ---------------------------------------------------------------------------

def daily_stage(attacks: DataFrame, key: str | None, tz) -> DataFrame:
    keys = [key] if key else []
    df = attacks.select(T.day_number(T.local_seconds_of_ms(F.col("timestamp"), tz)).alias("_day"), *keys)
    return df.groupBy("_day", *keys).agg(_count())


def daily_from_stage(agg: DataFrame, key: str | None) -> DataFrame:
    keys = [key] if key else []
    order = [F.desc("_day")] + ([F.desc("count"), F.asc(key)] if key else [])
    return agg.orderBy(*order).select(T.date_text_of_day("_day").alias("date"), *keys, "count")


def _daily(attacks: DataFrame, key: str | None, tz) -> DataFrame:
    return daily_from_stage(daily_stage(attacks, key, tz), key)


def view_daily_attacks(attacks: DataFrame, tz: str | None = None, **_) -> DataFrame:
    return _daily(attacks, None, tz)


def view_daily_usernames(attacks: DataFrame, tz: str | None = None, **_) -> DataFrame:
    return _daily(attacks, "username", tz)


def view_daily_passwords(attacks: DataFrame, tz: str | None = None, **_) -> DataFrame:
    return _daily(attacks, "password", tz)


def view_daily_source_ips(attacks: DataFrame, tz: str | None = None, **_) -> DataFrame:
    return _daily(attacks, "source_ip", tz)


# ---------------------------------------------------------------------------
# Per local minute, with calendar parts
# ---------------------------------------------------------------------------

def minute_counts(attacks: DataFrame, tz: str | None = None) -> DataFrame:
    """(_minute, count): attacks per local wall-clock minute (a long key)."""
    lsec = T.local_seconds_of_ms(F.col("timestamp"), tz)
    return attacks.select(T.floor_div(lsec, 60).alias("_minute")).groupBy("_minute").agg(_count())


def by_time_from_minutes(m: DataFrame) -> DataFrame:
    """Stage 2 of E9 over minute counts."""
    start = F.col("_minute") * 60
    day = T.day_number(start)
    date = T.date_of_day(day)
    return m.orderBy("_minute").select(
        T.date_text_of_day(day).alias("date"),
        T.month_text(date).alias("month"),
        T.week_of_year_text(date).alias("week_of_year"),
        T.weekday_text(date).alias("weekday"),
        T.day_of_month_text(date).alias("day_of_month"),
        T.hour_text(start).alias("hour_of_day"),
        T.minute_text(start).alias("minute_of_hour"),
        "count",
    )


def view_attacks_by_time(attacks: DataFrame, tz: str | None = None, **_) -> DataFrame:
    return by_time_from_minutes(minute_counts(attacks, tz))


# ---------------------------------------------------------------------------
# Behaviour per source address
# ---------------------------------------------------------------------------

def source_login_stage(attacks: DataFrame, tz: str | None = None) -> DataFrame:
    """Stage 1 of E11: one row per (source, username, password) with its
    count and first/last local second; partial aggregation map-side."""
    return (
        _with_local(attacks.select("timestamp", "source_ip", "username", "password"), tz)
        .groupBy("source_ip", "username", "password")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_lsec").alias("_first"), F.max("_lsec").alias("_last"))
    )


def login_is_odd(username="username", password="password") -> Column:
    """Whether a login's joined text may be that of another login too: a part holds the separator."""
    core = LOGIN_SEPARATOR.strip()
    return F.coalesce(F.col(username).contains(core) | F.col(password).contains(core), F.lit(False))


def patterns_by_source(per_login: DataFrame, ids: bool = False) -> DataFrame:
    """Counts and first and last second of each source, from distinct (source, username,
    password) rows, in one pass.

    A row stands for its user name, its password and, if its joined text may be that
    of another pair, its text, each under a tag; one aggregate makes these distinct
    and carries the sums with the password. Other logins are as many as their rows.
    ``ids``: the rows hold dictionary ids, and no value holds the separator."""
    whole = F.col("username").isNotNull() & F.col("password").isNotNull()
    nothing = F.lit(None).cast("long")
    empty = {"_n": nothing, "_first": nothing, "_last": nothing, "_logins": nothing}
    odd = F.lit(False) if ids else login_is_odd()
    sums = {"_n": F.col("_n"), "_first": F.col("_first"), "_last": F.col("_last"), "_logins": (whole & ~odd).cast("long")}

    def tagged(tag: int, key, values: dict):
        return F.struct(F.lit(tag).alias("_tag"), key.alias("_key"), *[v.alias(c) for c, v in values.items()])

    parts = [tagged(0, F.col("username"), empty), tagged(1, F.col("password"), sums)]
    if not ids:
        text = tagged(2, F.concat("username", F.lit(LOGIN_SEPARATOR), "password"), empty)
        parts = F.when(whole & odd, F.array(*parts, text)).otherwise(F.array(*parts))
    else:
        parts = F.array(*parts)
    rows = per_login.select("source_ip", F.inline(parts))
    keys = rows.groupBy("source_ip", "_tag", "_key").agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("_logins").alias("_logins"))
    number = lambda tag: F.count(F.when(F.col("_tag") == tag, F.col("_key")))
    return keys.groupBy("source_ip").agg(
        F.sum("_n").alias("total_attacks"),
        number(0).alias("unique_usernames"),
        number(1).alias("unique_passwords"),
        (F.coalesce(F.sum("_logins"), F.lit(0)) + number(2)).alias("unique_logins"),
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
    )


def attack_patterns_in_order(by_source: DataFrame) -> DataFrame:
    """The rows of E11, the most attacks first."""
    return by_source.orderBy(F.desc("total_attacks"), F.asc("source_ip")).select(
        "source_ip",
        "total_attacks",
        "unique_usernames",
        "unique_passwords",
        "unique_logins",
        T.clock_text("_first").alias("first_seen"),
        T.clock_text("_last").alias("last_seen"),
    )


def view_attack_patterns_by_source(attacks: DataFrame, tz: str | None = None, **_) -> DataFrame:
    return attack_patterns_in_order(patterns_by_source(source_login_stage(attacks, tz)))


# ---------------------------------------------------------------------------
# Credential fingerprints
# ---------------------------------------------------------------------------

def credential_source_stage(attacks: DataFrame, tz: str | None = None) -> DataFrame:
    """Stage 1 of E12/E16: one row per (username, password, source)."""
    return (
        _with_local(attacks.select("timestamp", "source_ip", "username", "password"), tz)
        .groupBy("username", "password", "source_ip")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_lsec").alias("_first"), F.max("_lsec").alias("_last"))
    )


_FINGERPRINT_COLUMNS = [
    "username",
    "password",
    "total_uses",
    "distinct_source_ips",
    "first_seen",
    "last_seen",
    "source_ips",
]


def _fingerprint_order(df: DataFrame) -> DataFrame:
    return df.orderBy(
        F.asc("distinct_source_ips"),
        F.desc("total_uses"),
        F.desc("last_seen"),
        F.asc("username"),
        F.asc("password"),
    )


def fingerprints_from_stage(per_src: DataFrame) -> DataFrame:
    """Stage 2 of E12 over distinct (credential, source) rows."""
    sources = F.array_sort(F.collect_list("source_ip"))
    agg = per_src.groupBy("username", "password").agg(
        F.sum("_n").alias("total_uses"),
        F.count("source_ip").alias("distinct_source_ips"),
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
        F.when(F.size(sources) > 0, F.array_join(sources, ",")).alias("source_ips"),
    )
    out = agg.select(
        "username",
        "password",
        "total_uses",
        "distinct_source_ips",
        T.clock_text("_first").alias("first_seen"),
        T.clock_text("_last").alias("last_seen"),
        "source_ips",
    )
    return _fingerprint_order(out).select(*_FINGERPRINT_COLUMNS)


def credential_sources(attacks: DataFrame, tz: str | None = None) -> DataFrame:
    """The fingerprints' sources as rows: (credential, source) with its uses
    and first and last time. The form for credentials used from more addresses
    than fit one list; no order, nothing is gathered in one row."""
    return credential_source_stage(attacks, tz).select(
        "username",
        "password",
        "source_ip",
        F.col("_n").alias("uses"),
        T.clock_text("_first").alias("first_seen"),
        T.clock_text("_last").alias("last_seen"),
    )


def view_credential_fingerprints(attacks: DataFrame, tz: str | None = None, **_) -> DataFrame:
    """Per credential: uses, distinct sources, first/last seen, source list.

    The source list is the sorted, comma-joined set of distinct addresses.
    Its length is part of the output, so a credential used from n addresses
    holds an n-address list; stage 1 makes sure only distinct addresses (not
    all rows) reach that group.
    """
    return fingerprints_from_stage(credential_source_stage(attacks, tz))


def new_fingerprints_from_stage(per_src: DataFrame, as_of=None, tz: str | None = None, days: int = 7) -> DataFrame:
    """Stage 2 of E16: single-source credentials first seen within ``days``."""
    agg = per_src.groupBy("username", "password").agg(
        F.sum("_n").alias("total_uses"),
        F.count("source_ip").alias("distinct_source_ips"),
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
        F.min("source_ip").alias("source_ips"),
    )
    cut = T.local_cutoff_seconds(as_of, days, tz)
    out = agg.filter((F.col("distinct_source_ips") == 1) & (F.col("_first") >= cut)).select(
        "username",
        "password",
        "total_uses",
        "distinct_source_ips",
        T.clock_text("_first").alias("first_seen"),
        T.clock_text("_last").alias("last_seen"),
        "source_ips",
    )
    return _fingerprint_order(out).select(*_FINGERPRINT_COLUMNS)


def report_new_credential_fingerprints_last_7_days(
    attacks: DataFrame, as_of=None, tz: str | None = None, days: int = 7, **_
) -> DataFrame:
    """Fingerprints used from exactly one source ever, first seen within
    ``days``. The filter needs full history, so it runs after the aggregate;
    a single source means min(source) = the list, so no list is built."""
    return new_fingerprints_from_stage(credential_source_stage(attacks, tz), as_of, tz, days)


# ---------------------------------------------------------------------------
# Top-n in a window ending now
# ---------------------------------------------------------------------------

def _top(attacks: DataFrame, keys, as_of, days: int, n: int) -> DataFrame:
    recent = since(attacks, as_of, days)
    return (
        recent.groupBy(*keys)
        .agg(_count())
        .orderBy(F.desc("count"), *[F.asc(k) for k in keys])
        .limit(n)
    )


def report_top_attackers_last_24_hours(attacks: DataFrame, as_of=None, n: int = TOP_N, **_) -> DataFrame:
    return _top(attacks, ["source_ip"], as_of, 1, n)


def report_top_usernames_last_7_days(attacks: DataFrame, as_of=None, n: int = TOP_N, **_) -> DataFrame:
    return _top(attacks, ["username"], as_of, 7, n)


def report_top_passwords_last_7_days(attacks: DataFrame, as_of=None, n: int = TOP_N, **_) -> DataFrame:
    return _top(attacks, ["password"], as_of, 7, n)


def report_top_logins_last_7_days(attacks: DataFrame, as_of=None, n: int = TOP_N, **_) -> DataFrame:
    return _top(attacks, ["username", "password"], as_of, 7, n)


# ---------------------------------------------------------------------------
# Spread of a user name over sources
# ---------------------------------------------------------------------------

def view_attack_spread_by_username(attacks: DataFrame, **_) -> DataFrame:
    per_src = attacks.groupBy("username", "source_ip").agg(F.count(F.lit(1)).alias("_n"))
    agg = per_src.groupBy("username").agg(
        F.sum("_n").alias("total_attempts"),
        F.count("source_ip").alias("distinct_attackers"),
    )
    return agg.orderBy(F.desc("total_attempts"), F.desc("distinct_attackers"), F.asc("username"))


# ---------------------------------------------------------------------------
# Hourly / daily totals since a local cut-off
# ---------------------------------------------------------------------------

def _bucket_totals(attacks: DataFrame, as_of, tz, days: int, width: int, step_unit: str) -> DataFrame:
    """Totals per local bucket of ``width`` seconds whose start is at or after
    the local clock of ``now - days`` cut to the bucket. Sparse: empty
    buckets give no row. to_time is wall-clock arithmetic (+1 hour / day)."""
    pre = since_local(attacks, as_of, days)  # superset, prunes the scan
    lsec = T.local_seconds_of_ms(F.col("timestamp"), tz)
    bucket = T.floor_div(lsec, width) * width
    cut = T.floor_div(T.local_cutoff_seconds(as_of, days, tz), width) * width
    agg = (
        pre.select(bucket.alias("_start"))
        .filter(F.col("_start") >= cut)
        .groupBy("_start")
        .agg(F.count(F.lit(1)).alias("total_attacks"))
    )
    return _bucket_rows(agg, step_unit)


def _bucket_rows(totals: DataFrame, step_unit: str) -> DataFrame:
    start = T.clock_of("_start")
    return totals.orderBy("_start").select(
        start.cast("string").alias("from_time"),
        F.timestamp_add(step_unit, F.lit(1), start).cast("string").alias("to_time"),
        "total_attacks",
    )


def totals_from_minutes(m: DataFrame, as_of, tz, days: int, width: int, step_unit: str) -> DataFrame:
    """The same totals from minute counts; the cut-off reaches a stored table's scan."""
    cut = T.floor_div(T.local_cutoff_seconds(as_of, days, tz), width) * width
    recent = m.filter(F.col("_minute") >= T.int_div(cut, 60))
    start = (T.floor_div(F.col("_minute") * 60, width) * width).alias("_start")
    return _bucket_rows(recent.select(start, "count").groupBy("_start").agg(F.sum("count").alias("total_attacks")), step_unit)


#: of the reports over time buckets: the bucket's seconds, its unit and the days shown
BUCKET_REPORTS = {
    "report_hourly_attacks_last_7_days": (3600, "HOUR", 7),
    "report_daily_attacks_last_90_days": (T.SECONDS_PER_DAY, "DAY", 90),
}


def report_hourly_attacks_last_7_days(attacks: DataFrame, as_of=None, tz: str | None = None, days: int = 7, **_) -> DataFrame:
    return _bucket_totals(attacks, as_of, tz, days, 3600, "HOUR")


def report_daily_attacks_last_90_days(attacks: DataFrame, as_of=None, tz: str | None = None, days: int = 90, **_) -> DataFrame:
    return _bucket_totals(attacks, as_of, tz, days, T.SECONDS_PER_DAY, "DAY")


# ---------------------------------------------------------------------------
# registry
# ---------------------------------------------------------------------------

VIEWS = {
    "view_usernames": view_usernames,
    "view_passwords": view_passwords,
    "view_source_ips": view_source_ips,
    "view_log": view_log,
    "view_daily_attacks": view_daily_attacks,
    "view_daily_usernames": view_daily_usernames,
    "view_daily_passwords": view_daily_passwords,
    "view_daily_source_ips": view_daily_source_ips,
    "view_attacks_by_time": view_attacks_by_time,
    "view_logins": view_logins,
    "view_attack_patterns_by_source": view_attack_patterns_by_source,
    "view_credential_fingerprints": view_credential_fingerprints,
    "report_top_attackers_last_24_hours": report_top_attackers_last_24_hours,
    "report_top_usernames_last_7_days": report_top_usernames_last_7_days,
    "report_top_passwords_last_7_days": report_top_passwords_last_7_days,
    "report_new_credential_fingerprints_last_7_days": report_new_credential_fingerprints_last_7_days,
    "view_attack_spread_by_username": view_attack_spread_by_username,
    "report_hourly_attacks_last_7_days": report_hourly_attacks_last_7_days,
    "report_daily_attacks_last_90_days": report_daily_attacks_last_90_days,
    "report_top_logins_last_7_days": report_top_logins_last_7_days,
}


def build_view(name: str, attacks: DataFrame, as_of=None, tz: str | None = None) -> DataFrame:
    return VIEWS[name](attacks, as_of=as_of, tz=tz)


def register_views(spark: SparkSession, attacks: DataFrame, as_of=None, tz: str | None = None) -> dict:
    """Register ``attacks`` and all twenty views as temporary views.

    A given ``as_of`` is fixed; without it, reports end at the time of each
    read, not of this call."""
    attacks.createOrReplaceTempView("attacks")
    out = {}
    for name, fn in VIEWS.items():
        df = fn(attacks, as_of=as_of, tz=tz)
        df.createOrReplaceTempView(name)
        out[name] = df
    return out
