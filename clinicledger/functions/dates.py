"""Date and timestamp expressions: literals, report windows, month buckets.

Four window dialects occur in the reports:

* ``end_plus_day``  - ``col >= start AND col < end + 1 day`` (whole last day)
* ``end_exclusive`` - ``col >= start AND col < end``          (raw end)
* ``between``       - ``col >= start AND col <= end``         (closed)
* ``bounded``       - as ``between``, but never true with an unset bound

Elsewhere an unset start means 1900-01-01 and an unset end 3000-01-01.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Open-ended bounds used for unset report dates.
OPEN_START = dt.datetime(1900, 1, 1)
OPEN_END = dt.datetime(3000, 1, 1)

WINDOW_MODES = ("end_plus_day", "end_exclusive", "between", "bounded")


def as_datetime(value: dt.date | dt.datetime | str) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    return dt.datetime.fromisoformat(value)


def ts_lit(value: dt.date | dt.datetime | str) -> Column:
    """A ``timestamp_ntz`` literal, independent of the session time zone."""
    return F.lit(as_datetime(value).isoformat(sep=" ", timespec="microseconds")).cast("timestamp_ntz")


def window_bounds(
    start: dt.datetime | dt.date | None, end: dt.datetime | dt.date | None, mode: str
) -> tuple[dt.datetime, dt.datetime, bool]:
    """Resolve a report window to ``(lower, upper, upper_inclusive)``."""
    if mode not in WINDOW_MODES:
        raise ValueError(f"unknown window mode {mode!r}; expected one of {WINDOW_MODES}")
    lo = as_datetime(start) if start is not None else OPEN_START
    hi = as_datetime(end) if end is not None else OPEN_END
    if mode == "end_plus_day":
        return lo, hi + dt.timedelta(days=1), False
    return lo, hi, mode in ("between", "bounded")


def in_window(
    col: Column | str,
    start: dt.datetime | dt.date | None,
    end: dt.datetime | dt.date | None,
    mode: str = "end_plus_day",
) -> Column:
    """Predicate ``col`` within the report window (NULL stays NULL, so a
    filter drops rows with a NULL date)."""
    c = F.col(col) if isinstance(col, str) else col
    lo, hi, inclusive = window_bounds(start, end, mode)
    if mode == "bounded" and (start is None or end is None):
        return F.lit(False)
    upper = c <= ts_lit(hi) if inclusive else c < ts_lit(hi)
    return (c >= ts_lit(lo)) & upper


def rolling_months(as_of: dt.date | dt.datetime, months: int = 12) -> tuple[dt.datetime, dt.datetime]:
    """Rolling window of whole months before ``as_of``: the first day of the
    month ``months`` back, to the last day of the previous month (00:00)."""
    first_of_month = dt.datetime(as_of.year, as_of.month, 1)
    y, m = divmod(first_of_month.year * 12 + first_of_month.month - 1 - months, 12)
    return dt.datetime(y, m + 1, 1), first_of_month - dt.timedelta(days=1)


def rolling_start(as_of: Column | str, months: int = 12) -> Column:
    """Column form of ``rolling_months(...)[0]`` for per-row as-of dates."""
    c = F.col(as_of) if isinstance(as_of, str) else as_of
    return F.add_months(F.trunc(c, "MM"), -months)


def rolling_end(as_of: Column | str) -> Column:
    """Column form of ``rolling_months(...)[1]``."""
    c = F.col(as_of) if isinstance(as_of, str) else as_of
    return F.date_sub(F.trunc(c, "MM"), 1)


def month_of(col: Column | str) -> Column:
    """``yyyy-MM`` bucket of a timestamp (string, as the reports print it)."""
    return F.date_format(col, "yyyy-MM")


def day_of(col: Column | str) -> Column:
    """Timestamp truncated to its date."""
    return F.to_date(col)
