"""Hot keys: one payment method carries a third of all visit transactions.

The skewed tables are derived from the sf0.001 test tables (every third
visit transaction is re-pointed to payment method 0). AQE's skew thresholds
are lowered to test scale so that its skew-join split shows up in the final
adaptive plan, and the report must still equal the staged-ledger path.
"""

from __future__ import annotations

import dataclasses

import pytest
from pyspark.sql import functions as F

from clinicledger.operators import filters, ledger
from clinicledger.plans.registry import ENCOUNTER
from clinicledger.sources.tables import Tables
from tests.conftest import rows

SKEW_CONF = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture()
def skewed_tables(spark, fixture_tables_small):
    t = fixture_tables_small
    vt = t.visit_transactions.withColumn(
        "payment_method_id",
        F.when(F.col("visit_transactions_id") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("payment_method_id")),
    )
    frames = {n: t.table(n) for n in Tables.names()}
    frames["visit_transactions"] = vt
    return Tables(**frames)


@pytest.fixture()
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_payment_method_is_split_and_results_hold(spark, skewed_tables, skew_conf):
    t = skewed_tables
    p = dataclasses.replace(ENCOUNTER, ordered=False)
    f = p.ledger_filter()
    eager = ledger.encounter_rollup(t, f, p.excluded_tickets).select(*ledger.REPORT_COLUMNS)
    eager.collect()  # run this DataFrame's own query, then read its final adaptive plan
    final_plan = eager._jdf.queryExecution().executedPlan().toString()
    got = rows(eager)
    assert "skew=true" in final_plan, "AQE did not split the hot payment-method partition"

    staged = ledger.rollup_ledger(
        filters.exclude_keys(ledger.build_ledger(ledger.charge_rows(t, f), ledger.payment_rows(t, f)),
                             "ticket_number", p.excluded_tickets),
        t,
    ).select(*ledger.REPORT_COLUMNS)
    assert got == rows(staged) and len(got) > 0


@pytest.fixture()
def hot_patient_tables(spark, fixture_tables_small):
    t = fixture_tables_small
    hot = F.when(F.col("patient_visit_id") % 3 == 0, F.lit(1).cast("bigint"))
    frames = {n: t.table(n) for n in Tables.names()}
    frames["patient_visit"] = t.patient_visit.withColumn(
        "patient_profile_id", hot.otherwise(F.col("patient_profile_id")))
    frames["patient_visit_agg"] = t.patient_visit_agg.withColumn(
        "patient_profile_id", hot.otherwise(F.col("patient_profile_id")))
    return Tables(**frames)


def test_hot_patient_is_split_and_results_hold(spark, hot_patient_tables, skew_conf):
    from clinicledger.plans import reports

    t = hot_patient_tables
    p = dataclasses.replace(ENCOUNTER, ordered=False)
    f = p.ledger_filter()
    eager = ledger.encounter_rollup(t, f, p.excluded_tickets).select(*ledger.REPORT_COLUMNS)
    eager.collect()
    assert "skew=true" in eager._jdf.queryExecution().executedPlan().toString()
    staged = ledger.rollup_ledger(
        filters.exclude_keys(ledger.build_ledger(ledger.charge_rows(t, f), ledger.payment_rows(t, f)),
                             "ticket_number", p.excluded_tickets),
        t,
    ).select(*ledger.REPORT_COLUMNS)
    assert rows(eager) == rows(staged)
    # the incentive report for the hot patient broadcasts its profile: no hot shuffle key
    vp = reports.visit_payments(t, "1")
    vp.collect()
    plan = vp._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and vp.count() > 0
