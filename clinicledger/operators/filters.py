"""Row filters of the reports (all plain predicates Catalyst pushes down).

NULL handling follows the reports' three-valued logic: a filter keeps a row
only when its predicate is TRUE, so NULL keys, names, amounts and dates drop
out of ``NOT IN``, ``NOT LIKE``, ``<>`` and range tests.
"""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clinicledger.constants import VOID_MARKER
from clinicledger.functions.dates import in_window, ts_lit
from clinicledger.functions.text import TEXT_COLLATION, contains_none, text_equals, text_key

# Lists longer than this become a broadcast semi/anti join instead of an
# IN-set predicate (the list is a driver-side parameter, so its size is
# known). Both forms select the same rows: NULL entries are ignored, values
# are compared as the column's type, a NULL column value matches nothing.
INLINE_LIST_MAX = 5_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sql_literal(v) -> str:
    """``v`` as a SQL literal of its own type."""
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, dt.datetime):
        return f"TIMESTAMP_NTZ '{v.isoformat(sep=' ', timespec='microseconds')}'"
    if isinstance(v, dt.date):
        return f"DATE '{v.isoformat()}'"
    if isinstance(v, decimal.Decimal):
        return f"{v:f}BD"
    if isinstance(v, float):
        return f"DOUBLE('{v!r}')"
    if isinstance(v, int):
        return f"{v}L" if abs(v) > 2**31 - 1 else str(v)
    # by code points: no character has a meaning inside the literal
    return "CAST(X'" + str(v).encode().hex() + "' AS STRING)"


def _listed(values: Sequence) -> list:
    return [v for v in dict.fromkeys(values) if v is not None]


def in_list(col: str, values: Sequence, collation: str | None = None) -> Column:
    """``col IN (values)`` built as one SQL expression: a long literal list
    reaches the JVM in one call instead of one call per value (Catalyst
    turns it into the same hashed IN-set). NULL entries are ignored.
    ``collation``: compare text under it."""
    values = _listed(values)
    if not values:
        return F.lit(False)
    tested = f"collate(`{col}`, '{collation}')" if collation else f"`{col}`"
    return F.expr(f"{tested} IN ({', '.join(_sql_literal(v) for v in values)})")


def date_type_column(date_type: str, service_col: str, entry_col: str) -> str | None:
    """Column a 'DOS' (date of service) or 'DOE' (date of entry) run filters
    on; any other value selects nothing, as in the reports."""
    return {"DOS": service_col, "DOE": entry_col}.get(date_type)


def date_window(
    df: DataFrame,
    col: Column | str | None,
    start: dt.datetime | dt.date | None,
    end: dt.datetime | dt.date | None,
    mode: str = "end_plus_day",
) -> DataFrame:
    """Keep rows whose ``col`` lies in the report window (see
    ``functions.dates`` for the three end-bound modes). ``col=None`` (an
    unknown date type) keeps nothing."""
    if col is None:
        return df.filter(F.lit(False))
    return df.filter(in_window(col, start, end, mode))


def _values_frame(df: DataFrame, values: Sequence, col: str) -> DataFrame:
    """A parameter list as a one-column table ``_listed_value`` typed like ``df[col]``;
    broadcast, since its size is the (driver-side) list length."""
    dtype = df.schema[col].dataType.simpleString()
    vals = df.sparkSession.createDataFrame([(v,) for v in values], f"_listed_value {dtype}")
    return F.broadcast(vals.distinct())


def _is_text(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, StringType)


def _among(df: DataFrame, col: str, values: Sequence) -> Column:
    """``col IN (values)``, text by the report database's rules."""
    return in_list(col, values, TEXT_COLLATION if _is_text(df, col) else None)


def optional_in(df: DataFrame, col: str, values: Sequence | None) -> DataFrame:
    """Optional multi-value filter: no predicate at all when ``values`` is
    None ("all"), else ``col IN (values)``; an empty list keeps nothing."""
    if values is None:
        return df
    values = _listed(values)
    if len(values) <= INLINE_LIST_MAX:
        return df.filter(in_list(col, values))
    return df.join(_values_frame(df, values, col), F.col(col) == F.col("_listed_value"), "left_semi")


def exclude_keys(df: DataFrame, col: str, excluded: Sequence | DataFrame) -> DataFrame:
    """``col NOT IN (excluded)``: rows with a NULL ``col`` are dropped too,
    whatever the length or form of ``excluded`` (also if it is empty); NULL
    entries are ignored. Text is compared by the report database's rules.

    A literal list compiles to a hashed IN-set inside generated code; a
    DataFrame of keys (any size) becomes an anti join, which Spark plans as a
    broadcast or a shuffle join from its measured size.
    """
    key = F.col(col)
    present = df.filter(key.isNotNull())
    shown = text_key if _is_text(df, col) else F.col
    if isinstance(excluded, DataFrame):
        (kcol,) = excluded.columns
        keys = excluded.select(F.col(kcol).alias("_excluded_key")).filter(F.col("_excluded_key").isNotNull())
        return present.join(keys, shown(col) == shown("_excluded_key"), "left_anti")
    values = _listed(excluded)
    if len(values) <= INLINE_LIST_MAX:
        if not _is_text(df, col) or not values:
            return present.filter(~in_list(col, values))
        # the exact test follows from the collated one; it reaches the scan
        return present.filter(~in_list(col, values) & ~_among(df, col, values))
    keys = _values_frame(df, values, col)
    return present.join(keys, shown(col) == shown("_listed_value"), "left_anti")


def exclude_test_patients(
    df: DataFrame, col: str, markers: Sequence[str], ignore_case: bool = True
) -> DataFrame:
    """Drop rows whose ``col`` contains any marker; a NULL ``col`` is
    dropped as well (``NOT LIKE`` on NULL is unknown)."""
    return df.filter(contains_none(col, markers, ignore_case))


def keep_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """``col IN (values)``; text by the report database's rules."""
    return df.filter(_among(df, col, values))


def drop_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """``col NOT IN (values)``; NULL ``col`` drops."""
    return df.filter(~_among(df, col, values))


def nonzero(df: DataFrame, col: str) -> DataFrame:
    """``col <> 0``; NULL drops."""
    return df.filter(F.col(col) != 0)


def equals(df: DataFrame, col: str, value) -> DataFrame:
    """``col = value``; text by the report database's rules."""
    return df.filter(text_equals(col, value) if isinstance(value, str) else F.col(col) == F.lit(value))


def collected_as_of_predicate(
    entry_col: Column | str, check_col: Column | str, closing: dt.datetime, cutoff: dt.date
) -> Column:
    """Payments counted at an accounting close.

    * entered before the day after the close, or
    * check dated before the day after the close but entered after it
      (strictly; no upper bound), or
    * entered between the close and the day after the cut-off date
      (inclusive; ``cutoff`` is a date, so that bound is midnight).
    """
    entry, check = _col(entry_col), _col(check_col)
    next_day = ts_lit(closing + dt.timedelta(days=1))
    after_cutoff = ts_lit(dt.datetime(cutoff.year, cutoff.month, cutoff.day) + dt.timedelta(days=1))
    return (
        (entry < next_day)
        | ((check < next_day) & (entry > next_day))
        | ((entry >= ts_lit(closing)) & (entry <= after_cutoff))
    )


def collected_as_of(
    df: DataFrame, entry_col: str, check_col: str, closing: dt.datetime, cutoff: dt.date
) -> DataFrame:
    return df.filter(collected_as_of_predicate(entry_col, check_col, closing, cutoff))


def exclude_void_visits(df: DataFrame, col: str, marker: str = VOID_MARKER) -> DataFrame:
    """Drop visits whose description contains the void marker (``NOT LIKE``;
    a NULL description drops too). Off in the reports: it removed valid
    encounters, so it exists for callers that want it."""
    return df.filter(~F.col(col).contains(F.lit(marker)))


def adjustment_mismatches(df: DataFrame, diff_col: str = "adjustments_diff") -> DataFrame:
    """Journal lines whose booked adjustments differ from those collected
    (lines without collections have a NULL difference and are not listed)."""
    return df.filter(F.col(diff_col) != 0)


KEY_RANGE_CONF = "clinicledger.keyRangePrefilter"


def within_key_range(df: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """Keep rows of ``df`` whose ``col`` lies between the smallest and the
    largest ``col`` of ``keys``: an exact pre-filter for a later join of the
    two on ``col``. Where surrogate ids grow with time, the ids of a date
    window form a narrow range, and with ``df`` stored sorted on ``col`` the
    Parquet min/max statistics skip every row group outside it (instead of
    reading the whole history to meet the window).

    Opt-in (session setting ``clinicledger.keyRangePrefilter=true``): it
    costs one small aggregation (two numbers) while the plan is built, which
    only pays off when ids do follow time, as they do in production tables
    but not in the test data."""
    if df.sparkSession.conf.get(KEY_RANGE_CONF, "false").lower() != "true":
        return df
    bounds = keys.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    if bounds is None or bounds["lo"] is None:
        return df.filter(F.lit(False))
    return df.filter(F.col(col).between(F.lit(bounds["lo"]), F.lit(bounds["hi"])))
