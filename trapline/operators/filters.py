"""Row filters: request routing, test records, incomplete rows, time windows.

All are plain ``filter`` calls over columns, so Catalyst pushes them into the
parquet scan (PushedFilters) wherever they touch stored columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timefn
from ..schema import SUBMIT_METHOD, SUBMIT_PATH, TEXT_COLUMNS


def only_submissions(requests: DataFrame, method_col: str = "method", path_col: str = "path") -> DataFrame:
    """Keep requests that carry a submission: POST to the submit path."""
    return requests.filter(
        (F.col(method_col) == F.lit(SUBMIT_METHOD)) & (F.col(path_col) == F.lit(SUBMIT_PATH))
    )


def drop_test(records: DataFrame, flag_col: str = "test_mode") -> DataFrame:
    """Drop records flagged as tests (a NULL flag counts as not a test)."""
    return records.filter(~F.coalesce(F.col(flag_col), F.lit(False)))


def drop_incomplete(df: DataFrame, columns=None, time_col: str | None = None) -> DataFrame:
    """Drop rows with a NULL in any of the six text columns (and in the time
    column when given: the coded table forbids NULL times)."""
    subset = list(columns or TEXT_COLUMNS)
    if time_col:
        subset.append(time_col)
    return df.na.drop(how="any", subset=subset)


def utc_date_text(ms_col="timestamp"):
    """UTC calendar date of epoch ms, the partition value of stored tables;
    NULL (Spark's default partition) for times outside years 0000 to 9999."""
    seconds = timefn.with_text(timefn.epoch_seconds(ms_col))
    return timefn.date_text_of_day(timefn.day_number(seconds))


def since(attacks: DataFrame, as_of=None, days: int = 1, time_col: str = "timestamp",
          date_col: str | None = "date") -> DataFrame:
    """Rows at or after ``now - days`` (whole seconds), no upper bound.

    The cut-off folds to a literal before the scan is planned, so
    ``timestamp >= lit`` reaches the parquet scan. If the frame has a UTC
    ``date`` partition column, a matching ``date >= ...`` filter is added so
    whole partitions are skipped; times without a date stay in.
    """
    cut = timefn.cutoff_ms(as_of, days)
    out = attacks.filter(F.col(time_col) >= cut)
    if date_col and date_col in attacks.columns:
        # ms div 1000 truncates toward zero; one spare day covers it
        first_day = timefn.day_number(timefn.epoch_seconds(cut)) - 1
        out = out.filter((F.col(date_col) >= timefn.date_text_of_day(first_day)) | F.col(date_col).isNull())
    return out


def since_local(attacks: DataFrame, as_of=None, days: int = 7, time_col: str = "timestamp",
                date_col: str | None = "date") -> DataFrame:
    """Coarse pre-filter for cut-offs on local wall-clock text.

    Keeps a superset of the rows whose local time can reach ``now - days``
    in any zone; the exact test on local text comes after. It prunes row
    groups and partitions for the hourly/daily reports.
    """
    margin_days = timefn.PREFILTER_MARGIN_SECONDS // timefn.SECONDS_PER_DAY
    return since(attacks, as_of, days + margin_days, time_col, date_col)
