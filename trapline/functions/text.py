"""Text helpers: trimming and the one-line record format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import timefn

# --- fixed values ------------------------------------------------------------
# Characters trimmed off stored evidence: blank, tab, line feed, carriage return.
ASCII_BLANKS = " \t\n\r"
# Unicode White_Space, trimmed off incoming evidence: tab, line feed,
# vertical tab, form feed, carriage return, blank, U+0085, U+00A0, U+1680,
# U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
UNICODE_BLANKS = (
    "\t\n\x0b\x0c\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Record line: time as day.month. hour:minute:second, then source padded to
# 15, user padded to 22, then password.
LOG_LINE_FORMAT = "%s | From: %-15s | User: %-22s | Pass: %s"
# ------------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_blanks(c) -> Column:
    """Trim blank, tab, LF, CR off both ends."""
    return F.btrim(_col(c), F.lit(ASCII_BLANKS))


def trim_unicode(c) -> Column:
    """Trim Unicode white space off both ends (a wider set than trim_blanks)."""
    return F.btrim(_col(c), F.lit(UNICODE_BLANKS))


def log_line(ms, source_ip, username, password, tz: str | None = None) -> Column:
    """One human-readable line per accepted record, time in zone ``tz``.

    The time reads day.month. hour:minute:second. It is cut from the zone-free
    text of the local clock (date_format would pass through the session zone).
    """
    clock = timefn.clock_text(timefn.local_seconds_of_ms(ms, tz))  # yyyy-MM-dd HH:mm:ss
    when = F.concat(
        F.substring(clock, 9, 2), F.lit("."), F.substring(clock, 6, 2), F.lit(". "),
        F.substring(clock, 12, 8),
    )
    return F.format_string(
        LOG_LINE_FORMAT, when, _col(source_ip), _col(username), _col(password)
    )
