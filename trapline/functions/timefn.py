"""Time helpers, all built from Spark's own expressions (codegen, no UDF).

The stored time is epoch milliseconds (bigint). Views show *local wall-clock
text* in a zone ``tz``. Instead of formatting every row and grouping on text,
the helpers turn epoch ms into **local wall-clock seconds** (a bigint: seconds
since 1970-01-01 00:00:00 on the local clock). Grouping, MIN/MAX and cut-off
comparisons run on that long; text is made only after the aggregate, on the
small result. Both orders agree: 'YYYY-MM-DD HH:MM:SS' text sorts like the
number, and two real instants that show the same wall-clock text (clock set
back) map to the same number.

Nothing here reads or sets the session time zone: zone conversion goes
through TIMESTAMP_NTZ and ``convert_timezone``, which ignore it.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400
# fixed values: the clock times that have a text, years 0000 to 9999; a time
# outside has none (NULL), whatever a sender or an old table put there
FIRST_SECOND, LAST_SECOND = -62167219200, 253402300799
_UTC_NAMES = {"UTC", "Etc/UTC", "GMT", "Etc/GMT", "Z", "+00:00", "UCT", "Etc/UCT", "Zulu"}


def _epoch_ntz() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def resolve_tz(tz: str | None) -> str:
    """Zone id to use: the given one, else the active session's zone."""
    if tz:
        return tz
    spark = SparkSession.getActiveSession()
    if spark is None:
        return "UTC"
    return spark.conf.get("spark.sql.session.timeZone") or "UTC"


def is_utc(tz: str) -> bool:
    return tz in _UTC_NAMES


def int_div(a, b: int) -> Column:
    """Integer division truncating toward zero (SQL ``div``)."""
    return F.call_function("div", _col(a), F.lit(b))


def floor_div(a, b: int) -> Column:
    """Integer division rounding toward minus infinity, exact on longs."""
    a = _col(a)
    return int_div(a - F.pmod(a, F.lit(b)), b)


def epoch_seconds(ms) -> Column:
    """Epoch ms -> whole seconds, truncated toward zero (SQL ``ms / 1000``)."""
    return int_div(ms, 1000)


def with_text(seconds) -> Column:
    """The seconds, NULL where they lie outside the years that have a text."""
    seconds = _col(seconds)
    return F.when(seconds.between(FIRST_SECOND, LAST_SECOND), seconds)


def local_seconds(seconds, tz: str | None = None) -> Column:
    """Epoch seconds -> local wall-clock seconds in zone ``tz`` (NULL: no text)."""
    tz = resolve_tz(tz)
    seconds = with_text(seconds)
    if is_utc(tz):
        return seconds
    utc_clock = F.timestamp_add("SECOND", seconds, _epoch_ntz())
    local_clock = F.convert_timezone(F.lit("UTC"), F.lit(tz), utc_clock)
    return F.timestamp_diff("SECOND", _epoch_ntz(), local_clock)


def local_seconds_of_ms(ms, tz: str | None = None) -> Column:
    return local_seconds(epoch_seconds(ms), tz)


def clock_of(local_sec) -> Column:
    """Local wall-clock seconds -> TIMESTAMP_NTZ (no zone involved)."""
    return F.timestamp_add("SECOND", _col(local_sec), _epoch_ntz())


def clock_text(local_sec) -> Column:
    """Local seconds -> 'YYYY-MM-DD HH:MM:SS'."""
    return clock_of(local_sec).cast("string")


def day_number(local_sec) -> Column:
    return floor_div(local_sec, SECONDS_PER_DAY)


def date_of_day(day) -> Column:
    return F.date_add(F.lit(_dt.date(1970, 1, 1)), _col(day).cast("int"))


def date_text_of_day(day) -> Column:
    """Day number -> 'YYYY-MM-DD'."""
    return date_of_day(day).cast("string")


def two_digits(x) -> Column:
    return F.lpad(_col(x).cast("string"), 2, "0")


def hour_text(local_sec) -> Column:
    return two_digits(int_div(F.pmod(_col(local_sec), F.lit(SECONDS_PER_DAY)), 3600))


def minute_text(local_sec) -> Column:
    return two_digits(int_div(F.pmod(_col(local_sec), F.lit(3600)), 60))


def month_text(date) -> Column:
    return two_digits(F.month(_col(date)))


def day_of_month_text(date) -> Column:
    return two_digits(F.dayofmonth(_col(date)))


def week_of_year_text(date) -> Column:
    """Week of the year, weeks start on Monday, days before the first Monday
    are week 00 (strftime ``%W``). Not ISO ``weekofyear``."""
    d = _col(date)
    return two_digits(int_div(F.dayofyear(d) + 6 - F.weekday(d), 7))


def weekday_text(date) -> Column:
    """Day of week, 0 = Sunday (strftime ``%w``)."""
    return (F.dayofweek(_col(date)) - 1).cast("string")


# ---------------------------------------------------------------------------
# "now" and cut-offs: foldable expressions, literals by the time a scan is
# planned, so that they are pushed down. A given ``as_of`` is fixed; without
# one, "now" is the time of each execution, also in a registered view.
# ---------------------------------------------------------------------------

def as_of_seconds(as_of=None) -> int:
    """Whole epoch seconds of ``as_of`` (floor). Accepts None (now), an
    aware or naive-UTC datetime, epoch seconds, or ISO text (UTC if no zone)."""
    if as_of is None:
        as_of = _dt.datetime.now(_dt.timezone.utc)
    if isinstance(as_of, (int, float)):
        return int(as_of // 1)
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of.replace("Z", "+00:00"))
    if isinstance(as_of, _dt.datetime):
        if as_of.tzinfo is None:
            as_of = as_of.replace(tzinfo=_dt.timezone.utc)
        delta = as_of - _dt.datetime(1970, 1, 1, tzinfo=_dt.timezone.utc)
        return delta.days * SECONDS_PER_DAY + delta.seconds
    raise TypeError(f"unsupported as_of: {as_of!r}")


def now_seconds(as_of=None) -> Column:
    """Whole epoch seconds of ``as_of``, or of the execution's own time."""
    return F.unix_seconds(F.current_timestamp()) if as_of is None else F.lit(as_of_seconds(as_of)).cast("long")


def cutoff_ms(as_of=None, days: int = 0) -> Column:
    """Instant cut-off ``(now - days)`` in whole seconds, times 1000."""
    return (now_seconds(as_of) - F.lit(days * SECONDS_PER_DAY)) * F.lit(1000).cast("long")


def local_cutoff_seconds(as_of=None, days: int = 0, tz: str | None = None) -> Column:
    """Local wall-clock seconds of ``now - days``; a foldable expression."""
    return local_seconds(now_seconds(as_of) - F.lit(days * SECONDS_PER_DAY), tz)


# Widest UTC offset in use is +-14h; 18h is the bound the zone rules allow.
# A row whose local bucket is at or after a local cut-off truncated to a day
# lies at most 2 * 18h + 24h before the instant cut-off.
PREFILTER_MARGIN_SECONDS = 3 * SECONDS_PER_DAY


# ---------------------------------------------------------------------------
# Flexible time text -> epoch ms
# ---------------------------------------------------------------------------

# fixed values: the two accepted spellings of a submission time
#   RFC 3339 with optional fraction and Z or +-hh:mm offset
#   the same without zone (read as local time in tz)
# The hour may have one digit and the fraction may follow a comma, as the
# original's lenient parser allows.
FLEX_TIME_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{1,2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})?$"
_ZONED = r"(Z|[+-]\d{2}:\d{2})$"
_OFFSET = r"([+-])(\d{2}):(\d{2})$"
# fixed values: the largest hours and minutes of an offset
MAX_OFFSET_HOURS, MAX_OFFSET_MINUTES = 24, 60
_COMMA_FRACTION = r"^(\d{4}-\d{2}-\d{2}T\d{1,2}:\d{2}:\d{2}),(\d)"


def _offset_millis(t: Column) -> Column:
    """Milliseconds of the offset at the end of a zoned time, NULL if too large."""
    hours, minutes = (F.regexp_extract(t, _OFFSET, k).try_cast("long") for k in (2, 3))
    size = (hours * 60 + minutes) * 60_000
    signed = F.when(F.regexp_extract(t, _OFFSET, 1) == F.lit("-"), -size).otherwise(size)
    fits = (hours <= MAX_OFFSET_HOURS) & (minutes <= MAX_OFFSET_MINUTES)
    return F.when(t.endswith("Z"), F.lit(0).cast("long")).when(fits, signed)


def parse_flexible_time(text, tz: str | None = None) -> Column:
    """Submission time text -> epoch ms, NULL when no layout fits.

    A zoned clock is read as UTC and its offset subtracted by arithmetic, so
    that offsets of up to 24 hours hold; zone-less text gets the zone id
    appended so Spark applies that zone's rules (DST included), independent of
    the session zone. Out-of-range parts (Feb 30, hour 24, second 60) fail the
    cast and give NULL. ms are the floor of the instant.
    """
    tz = resolve_tz(tz)
    t = _col(text)
    t_dot = F.when(t.contains(","), F.regexp_replace(t, _COMMA_FRACTION, "$1.$2")).otherwise(t)
    zoned = t.rlike(_ZONED)
    as_utc = F.concat(F.regexp_replace(t_dot, _ZONED, ""), F.lit("Z")).try_cast("timestamp")
    local = F.concat(t_dot, F.lit(" " + tz)).try_cast("timestamp")
    millis = F.when(zoned, F.unix_millis(as_utc) - _offset_millis(t)).otherwise(F.unix_millis(local))
    return F.when(t.rlike(FLEX_TIME_PATTERN), millis)
