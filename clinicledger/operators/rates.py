"""Effective-dated rates from a rate table (range / as-of lookup).

A rate table has rows ``(valid_from, valid_to, rate)``: the rate applies to
dates ``valid_from <= d < valid_to``; a NULL bound is open. Intervals must
not overlap. ``RateSchedule.as_rows`` turns the report's schedule (first
interval closed on the right) into such rows, so both forms agree.

Three plans, chosen by the table's checked size:

* up to ``BROADCAST_MAX_INTERVALS`` rows: the table is broadcast and matched
  with the range condition (a broadcast nested-loop left join: the big side
  streams through, nothing is shuffled, each row tests a handful of
  intervals);
* up to ``SEARCH_MAX_INTERVALS`` rows: the sorted bounds are three constant
  arrays in the plan, and each row finds its interval by binary search, an
  expression of its own: no join, and the big side is never shuffled;
* larger tables: an exact year-bucketed equi-join. Every interval is listed
  under each calendar year it overlaps (open ends clamped to the table's
  first and last finite year), every row looks up its own year (clamped the
  same way), and the range condition then picks the interval. Both sides
  are shuffled on the year, with no cap on candidates.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinicledger.functions.classify import RateSchedule
from clinicledger.operators.dims import rows_at_most

BROADCAST_MAX_INTERVALS = 1_000
#: bounds that travel in a plan: about 60 bytes an interval
SEARCH_MAX_INTERVALS = 200_000
RATE_TABLE_SCHEMA = "valid_from timestamp_ntz, valid_to timestamp_ntz, rate decimal(10,2)"
_ONE_MICROSECOND = dt.timedelta(microseconds=1)


def schedule_rows(schedule: RateSchedule) -> list[tuple[dt.datetime | None, dt.datetime | None, Decimal | None]]:
    """Half-open rows equivalent to the schedule's CASE ladder (the first
    interval includes its end date: it ends one microsecond later)."""
    rows = []
    for i, (lo, hi, rate) in enumerate(schedule.intervals()):
        if i == 0:
            hi = hi + _ONE_MICROSECOND
        elif i == 1:
            lo = lo + _ONE_MICROSECOND
        rows.append((lo, hi, rate))
    return rows


def schedule_table(spark: SparkSession, schedule: RateSchedule) -> DataFrame:
    return spark.createDataFrame(schedule_rows(schedule), RATE_TABLE_SCHEMA)


def _in_interval(d: Column, lo: Column, hi: Column) -> Column:
    return (lo.isNull() | (d >= lo)) & (hi.isNull() | (d < hi))


def effective_rate_from_table(
    df: DataFrame, rates: DataFrame, date_col: str, out: str = "rate",
    broadcast_max: int = BROADCAST_MAX_INTERVALS, search_max: int = SEARCH_MAX_INTERVALS,
) -> DataFrame:
    """Add ``out``: the rate whose interval contains ``date_col`` (NULL when
    none does, or when the date is NULL). Intervals whose end isn't after
    their start contain nothing."""
    r = rates.select(
        F.col("valid_from").alias("_rate_from"), F.col("valid_to").alias("_rate_to"),
        F.col("rate").alias(out),
    )
    d = F.col(date_col)
    if rows_at_most(rates, broadcast_max):
        cond = _in_interval(d, F.col("_rate_from"), F.col("_rate_to"))
        return df.join(F.broadcast(r), cond, "left").drop("_rate_from", "_rate_to")
    if rows_at_most(rates, search_max):
        return df.withColumn(out, searched_rate(r, d, out))
    return _year_bucketed(df, r, d, out)


def _constant_array(values: list, kind: str) -> Column:
    """An array literal: one string that the optimizer splits and casts once."""
    text = ",".join("" if v is None else str(v) for v in values)
    return F.split(F.lit(text), ",").try_cast(f"array<{kind}>")


def searched_rate(r: DataFrame, d: Column, out: str) -> Column:
    """The rate of the interval that contains ``d``, by binary search over
    the sorted starts of ``r`` (``_rate_from``, ``_rate_to``, ``out``; a
    size-checked table)."""
    rows = sorted(
        (x for x in r.collect() if x[0] is None or x[1] is None or x[0] < x[1]), key=lambda x: (x[0] is not None, x[0] or dt.datetime.min)
    )
    rate_type = r.schema[out].dataType.simpleString()
    if not rows:
        return F.lit(None).cast(rate_type)
    starts, ends = (_constant_array([x[k] and x[k].isoformat() for x in rows], "timestamp_ntz") for k in (0, 1))
    rates = _constant_array([x[2] for x in rows], rate_type)
    when = d.cast("timestamp_ntz")

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s.low + s.high, 1)
        start = F.get(starts, middle)
        right = (s.low < s.high) & (start.isNull() | (start <= s.date))
        return F.struct(
            F.when(right, middle + 1).otherwise(s.low).alias("low"), F.when(right, s.high).otherwise(F.least(middle, s.high)).alias("high"), s.date.alias("date")
        )

    def found(s: Column) -> Column:
        at = s.low - 1
        inside = s.date.isNotNull() & (F.get(ends, at).isNull() | (s.date < F.get(ends, at)))
        return F.when((at >= 0) & inside, F.get(rates, at))

    begin = F.struct(F.lit(0).alias("low"), F.lit(len(rows)).alias("high"), when.alias("date"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(rows).bit_length() + 1)), begin, halve, found)


def _year_bucketed(df: DataFrame, r: DataFrame, d: Column, out: str) -> DataFrame:
    # first and last finite boundary year of the table (two scalars)
    bounds = r.select(
        F.least(F.min(F.year("_rate_from")), F.min(F.year("_rate_to"))).alias("lo"),
        F.greatest(F.max(F.year("_rate_from")), F.max(F.year("_rate_to"))).alias("hi"),
    ).first()
    lo, hi = int(bounds["lo"]), int(bounds["hi"])

    def clamp(year: Column) -> Column:
        return F.least(F.greatest(year, F.lit(lo)), F.lit(hi))

    first = F.coalesce(clamp(F.year("_rate_from")), F.lit(lo))
    last = F.coalesce(clamp(F.year(F.col("_rate_to") - F.expr("INTERVAL 1 MICROSECOND"))), F.lit(hi))
    listed = r.withColumn("_rate_year", F.explode(F.sequence(first, last)))
    keyed = df.withColumn("_row_year", clamp(F.year(d)))
    cond = (F.col("_row_year") == F.col("_rate_year")) & _in_interval(d, F.col("_rate_from"), F.col("_rate_to"))
    return keyed.join(listed, cond, "left").drop("_row_year", "_rate_year", "_rate_from", "_rate_to")
