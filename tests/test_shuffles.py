"""What the reports' plans shuffle, with size-based broadcasts off."""

from __future__ import annotations

import contextlib
import re
from decimal import Decimal

import pytest

import __spark_entry__ as entry
from clinicledger.operators import closing
from clinicledger.operators.collections import payment_lines
from clinicledger.sources import store
from tests.conftest import SMOKE_DIR, rows
from tests.test_plans import _path_to_join, _plan


@contextlib.contextmanager
def _settings(spark, **more):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", **more}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _shuffles_above(plan: str, table: str) -> int:
    """Exchanges between the first scan of ``table`` and the plan's root."""
    lines = plan.splitlines()

    def depth(line):
        return len(line) - len(line.lstrip(" :+-"))

    at = next(i for i, line in enumerate(lines) if "FileScan" in line and re.search(rf"[_/]{table}[\[\]]", line))
    d, found = depth(lines[at]), 0
    for line in reversed(lines[:at]):
        if depth(line) < d:
            d = depth(line)
            found += line.strip(" :+-").startswith("Exchange")
    return found


def test_line_aggregates_stay_in_place_in_any_session(spark):
    with _settings(spark, **{"spark.sql.requireAllClusterKeysForCoPartition": "true"}):
        for name in ("charge_math", "adjustment_check"):
            for path in _path_to_join(_plan(entry.queries()[name](spark, SMOKE_DIR)), "patient_visit_procs_agg"):
                assert not any(p.startswith("Exchange") for p in path), (name, path)


def test_a_layout_has_no_fewer_buckets_than_a_shuffle_partitions(spark):
    with _settings(spark, **{"spark.sql.shuffle.partitions": "300"}):
        assert store.default_buckets(spark) == 512


def test_all_distributions_are_shuffled_twice(spark):
    with _settings(spark):
        plan = _plan(entry.queries()["nonzero_distributions"](spark, SMOKE_DIR))
        assert _shuffles_above(plan, "transaction_distributions") == 2


def test_stored_sums_add_one_shuffle_to_the_chain(spark, fixture_tables_small):
    with _settings(spark):
        plan = _plan(closing.both_grains(fixture_tables_small))
    assert _shuffles_above(plan, "transaction_distributions") == 3


def test_repeated_and_null_keys_of_the_chain_give_the_rows_of_its_joins(make_tables):
    t = make_tables(
        transaction_distributions=[dict(transactions_id=k, patient_visit_procs_id=p, amount=Decimal(a))
                                   for k, p, a in [(1, 1, 5), (1, 1, 5), (2, 2, 0), (2, None, 3), (None, 3, 4), (3, 3, 1)]],
        transactions=[dict(transactions_id=k, visit_transactions_id=v, action="P") for k, v in [(1, 10), (1, 10), (2, 11), (3, None)]],
        visit_transactions=[dict(visit_transactions_id=v, patient_visit_id=p, payment_method_id=m)
                            for v, p, m in [(10, 100, 7), (10, 101, 7), (10, None, 8), (11, 102, 7), (None, 103, 7), (11, 104, None)]],
        payment_method=[dict(payment_method_id=m, source=s) for m, s in [(7, 1), (7, 2), (8, 1), (None, 2)]],
    )
    cols = ("transactions_id", "patient_visit_procs_id", "patient_visit_id", "amount", "action", "source")
    chain = (t.transaction_distributions.join(t.transactions, "transactions_id")
             .join(t.visit_transactions.select("visit_transactions_id", "payment_method_id"), "visit_transactions_id")
             .join(t.payment_method.select("payment_method_id", "source"), "payment_method_id"))
    want = chain.join(t.visit_transactions.select("visit_transactions_id", "patient_visit_id"), "visit_transactions_id")
    assert rows(payment_lines(t, visits=True), *cols) == rows(want, *cols) and want.count() > 30
    assert payment_lines(t).count() == chain.count()


def test_a_store_without_its_success_file_does_not_open(spark, fixture_tables_small, tmp_path):
    path = tmp_path / "sums"
    sums = closing.write_close_sums(fixture_tables_small, str(path))
    assert sums.days.count() >= sums.months.count() > 0
    closing.both_grains(fixture_tables_small).limit(5).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy(
        "grain", "entry_month").parquet(str(tmp_path / "part"))
    with pytest.raises(FileNotFoundError, match="does not exist"):
        closing.open_close_sums(spark, str(tmp_path / "part"))
