"""Accounting closes from stored sums: equal to the direct predicate at every
instant, days read only where a month is cut."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from clinicledger.operators import closing
from clinicledger.operators.collections import PIVOT_COLUMNS, collection_totals
from clinicledger.operators.filters import collected_as_of_predicate
from clinicledger.plans import registry, reports
from tests.conftest import SMOKE_DIR, rows

D, T = dt.date, dt.datetime
INSTANTS = [T(1997, 1, 31, 23, 59, 59), T(1997, 2, 1), T(1997, 2, 1, 12), T(1997, 2, 14), T(1997, 3, 1), T(1997, 3, 2, 7),
            T(1997, 4, 30), T(1998, 1, 1), None]
CLOSES = [T(1997, 1, 31), T(1997, 1, 31, 12), T(1997, 2, 13), T(1997, 2, 28, 7), T(1997, 3, 1, 7), T(1997, 12, 31), T(1996, 1, 1)]
CUTOFFS = [D(1997, 1, 31), D(1997, 2, 13), D(1997, 4, 29), D(1996, 1, 1), D(1997, 12, 31)]


@pytest.fixture(scope="module")
def chain(spark, make_tables, tmp_path_factory):
    """A payment or adjustment per pair of instants on four lines, each a power
    of two, so that a line's sums tell which were counted."""
    pairs = [(e, c) for e in INSTANTS for c in INSTANTS]
    t = make_tables(
        transaction_distributions=[
            dict(transactions_id=k, patient_visit_procs_id=1 + k // 26, amount=Decimal(2) ** (k % 26)) for k in range(len(pairs))
        ],
        transactions=[dict(transactions_id=k, visit_transactions_id=k, action=("P", "A", "p ")[k % 3], action_type_mid=None)
                      for k in range(len(pairs))],
        visit_transactions=[dict(visit_transactions_id=k, patient_visit_id=7, payment_method_id=k) for k in range(len(pairs))],
        payment_method=[dict(payment_method_id=k, source=1 + k % 2, date_of_entry=e, check_date=c)
                        for k, (e, c) in enumerate(pairs)],
    )
    lines = spark.createDataFrame([(k, 7) for k in range(1, 5)], "patient_visit_procs_id bigint, patient_visit_id bigint")
    return t, lines, closing.write_close_sums(t, str(tmp_path_factory.mktemp("close") / "sums"))


@pytest.mark.parametrize("close", CLOSES)
def test_every_close_equals_the_direct_plan(chain, close):
    t, lines, sums = chain
    for cutoff in CUTOFFS:
        cols = ("patient_visit_id", "patient_visit_procs_id", *PIVOT_COLUMNS)
        stored = rows(closing.closed_totals(sums, lines, close, cutoff), *cols)
        assert stored == rows(collection_totals(t, lines, close, cutoff), *cols)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.datetimes(T(1996, 12, 1), T(1998, 2, 1)), st.dates(D(1996, 12, 1), D(1998, 2, 1)))
def test_any_close(chain, close, cutoff):
    t, lines, sums = chain
    cols = ("patient_visit_procs_id", *PIVOT_COLUMNS)
    assert rows(closing.closed_totals(sums, lines, close, cutoff), *cols) == rows(
        collection_totals(t, lines, close, cutoff), *cols)


def test_days_are_read_for_cut_months_only(chain):
    _, _, sums = chain
    entry, check = closing.cut_months(T(1997, 2, 28, 7), D(1997, 4, 29))
    assert entry == [D(1997, 2, 1), D(1997, 3, 1), D(1997, 4, 1)] and check == D(1997, 3, 1)
    plan = closing.closed_sums(sums, T(1997, 2, 28, 7), D(1997, 4, 29))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(" in plan and "entry_month" in plan.split("PartitionFilters:")[1][:400]


def test_incomplete_store_does_not_open(spark, chain, tmp_path):
    _, _, sums = chain
    sums.days.limit(1).write.parquet(str(tmp_path / "half" / "days"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        closing.open_close_sums(spark, str(tmp_path / "half"))


def test_no_payments(spark, make_tables, tmp_path):
    empty = closing.write_close_sums(make_tables(), str(tmp_path / "none"))
    lines = spark.createDataFrame([(1, 7)], "patient_visit_procs_id bigint, patient_visit_id bigint")
    assert closing.closed_totals(empty, lines, CLOSES[0], CUTOFFS[0]).count() == 0


def test_journal_from_stored_sums_equals_journal(spark, fixture_tables_small):
    sums = registry.close_sums(spark, SMOKE_DIR)
    direct = reports.revenue_journal(fixture_tables_small, registry.REVENUE)
    assert rows(reports.revenue_journal(fixture_tables_small, registry.REVENUE, sums=sums)) == rows(direct)


def test_the_predicate_is_never_true_without_an_entry_date(spark):
    df = spark.createDataFrame([(None, T(1997, 1, 1))], "e timestamp_ntz, c timestamp_ntz")
    assert df.filter(collected_as_of_predicate("e", "c", CLOSES[0], CUTOFFS[0])).count() == 0
