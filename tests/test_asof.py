"""Rates from tables of every size: nested loop, binary search, year buckets."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from conftest import rows

from clinicledger.functions.classify import RateSchedule, effective_rate
from clinicledger.operators import rates

START = dt.datetime(1990, 1, 1)


def table(n, seed=1):
    """``n`` intervals with gaps, open at both ends."""
    rng = random.Random(seed)
    at, out = START, []
    for k in range(n):
        end = at + dt.timedelta(seconds=rng.randint(1, 40_000), microseconds=rng.randint(0, 999_999))
        out.append((at, end, None if k % 17 == 3 else Decimal(k % 9000) / 100))
        at = end + (dt.timedelta(seconds=rng.randint(1, 9_000)) if rng.random() < 0.3 else dt.timedelta())
    return [(None, *out[0][1:]), *out[1:-1], (out[-1][0], None, out[-1][2])]


def days(spark, intervals, seed=2):
    rng = random.Random(seed)
    bounds = [b for lo, hi, _ in rng.sample(intervals, min(len(intervals), 60)) for b in (lo, hi) if b]
    tick = dt.timedelta(microseconds=1)
    found = [None, dt.datetime(1900, 1, 1), dt.datetime(3000, 1, 1), *bounds, *[b - tick for b in bounds], *[b + tick for b in bounds]]
    return spark.createDataFrame([(k, d) for k, d in enumerate(found)], "k int, d timestamp_ntz"), found


def expected(found, intervals):
    def rate(d):
        return next((r for lo, hi, r in intervals if d is not None and (lo is None or lo <= d) and (hi is None or d < hi)), None)

    return [(k, rate(d)) for k, d in enumerate(found)]


@pytest.mark.parametrize("n,plan", [(2, "search"), (5, "search"), (700, "search"), (700, "join"), (700, "years")])
def test_every_plan_finds_the_interval(spark, n, plan):
    intervals = table(n)
    frame, found = days(spark, intervals)
    shuffled = random.Random(3).sample(intervals, n)
    empty = [(START, START, Decimal(1)), (dt.datetime(2001, 1, 1), dt.datetime(2000, 1, 1), Decimal(2))]
    sizes = {"search": (0, 10_000), "join": (10_000, 0), "years": (0, 0)}[plan]
    given = spark.createDataFrame(shuffled + (empty if plan == "search" else []), rates.RATE_TABLE_SCHEMA)
    got = rates.effective_rate_from_table(frame, given, "d", broadcast_max=sizes[0], search_max=sizes[1])
    assert sorted((r.k, r.rate) for r in got.select("k", "rate").collect()) == expected(found, intervals)


def test_hundred_thousand_intervals_without_an_exchange(spark):
    intervals = table(100_000)
    frame, found = days(spark, intervals)
    got = rates.effective_rate_from_table(frame, spark.createDataFrame(intervals, rates.RATE_TABLE_SCHEMA), "d")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert sorted((r.k, r.rate) for r in got.select("k", "rate").collect()) == expected(found, intervals)


def test_search_equals_the_ladder_on_boundaries(spark):
    schedule = RateSchedule()
    intervals = rates.schedule_rows(schedule)
    frame, _ = days(spark, intervals)
    searched = rates.effective_rate_from_table(frame, rates.schedule_table(spark, schedule), "d", broadcast_max=0)
    assert rows(searched, "k", "rate") == rows(frame.select("k", effective_rate("d", schedule).alias("rate")))


def test_empty_rate_table(spark):
    frame, _ = days(spark, table(3))
    got = rates.effective_rate_from_table(frame, spark.createDataFrame([], rates.RATE_TABLE_SCHEMA), "d", broadcast_max=-1)
    assert got.filter("rate is not null").isEmpty() and got.schema["rate"].dataType.simpleString() == "decimal(10,2)"
