"""Report plans: driver contract, ordering, plan shape, oracle agreement."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from clinicledger.operators import ledger
from clinicledger.plans import reports
from clinicledger.plans.registry import ENCOUNTER, REVENUE
from clinicledger.sources.tables import assert_unique_keys
from scripts.compare import compare, duck_connect
from clinicledger.plans.registry import QUERIES as REPORT_QUERIES
from tests.conftest import SMOKE_DIR


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["ticket_number", "patient_id", "date_of_service"]
    assert df.count() > 0


def test_contract_keys_match():
    assert set(REPORT_QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_fixture_keys_unique(fixture_tables_small):
    # T22: the semi-join rewrites assume unique dimension and fact keys
    assert_unique_keys(fixture_tables_small)


def test_encounter_report_order(fixture_tables_small):
    # O2: company, facility, ticket (company is not an output column)
    rep = reports.encounter_report(fixture_tables_small, ENCOUNTER)
    full = ledger.encounter_rollup(fixture_tables_small, ENCOUNTER.ledger_filter(), ENCOUNTER.excluded_tickets)
    keys = [(r.company_name, r.facility_name, r.ticket_number) for r in
            full.orderBy("company_name", "facility_name", "ticket_number").collect()]
    got = [(r.facility_name, r.ticket_number) for r in rep.collect()]
    assert got == [(f, tk) for _, f, tk in keys]


def test_revenue_journal_order(fixture_tables_small):
    # O1: service timestamp, then visit (visit not an output column)
    rep = reports.revenue_journal(fixture_tables_small, REVENUE).collect()
    days = [r.date_of_service for r in rep]
    assert days == sorted(days) and len(days) > 0


def test_include_resource_other_values_give_no_rows(fixture_tables_small):
    import dataclasses

    p = dataclasses.replace(ENCOUNTER, include_resource=2)
    rep = reports.encounter_report(fixture_tables_small, p)
    assert rep.count() == 0 and rep.columns == reports.encounter_report(fixture_tables_small, ENCOUNTER).columns


@pytest.mark.parametrize("name", ["encounter_report", "revenue_journal", "visit_payments", "collections"])
def test_report_plans_stay_in_the_jvm(spark, name):
    plan = _plan(entry.queries()[name](spark, SMOKE_DIR))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, bad
    assert "BroadcastHashJoin" in plan


def test_staged_ledger_combines_before_shuffling(spark):
    """The staged ledger is combined by a partial aggregate (per visit and
    ledger key) before its shuffle."""
    plan = _plan(entry.queries()["ledger_rollup"](spark, SMOKE_DIR))
    lines = plan.splitlines()
    ex = next(i for i, line in enumerate(lines)
              if "Exchange hashpartitioning(patient_visit_id" in line and "doctor_name" in line)
    assert "HashAggregate" in lines[ex + 1] and "partial_sum" in lines[ex + 1]


def test_encounter_amounts_aggregate_before_shuffling(spark):
    """Eager aggregation: line amounts are combined map-side (partial
    aggregate) before the one shuffle on the amount keys, and the report's
    visit join happens after it."""
    plan = _plan(entry.queries()["encounter_report"](spark, SMOKE_DIR))
    lines = plan.splitlines()
    ex = next(i for i, line in enumerate(lines)
              if "Exchange hashpartitioning(patient_visit_id" in line and "cpt_code" in line and "hcpc" in line)
    assert "HashAggregate" in lines[ex + 1] and "partial_sum" in lines[ex + 1]


def test_date_window_reaches_the_scan(spark):
    plan = _plan(entry.queries()["date_window_dos"](spark, SMOKE_DIR))
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "PushedFilters" in scan and "date_of_service_from" in scan.split("PushedFilters")[1]


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SMOKE_DIR)


@pytest.mark.parametrize("name", sorted(REPORT_QUERIES))
def test_matches_oracle_sf0001(spark, duck, name):
    df = entry.queries()[name](spark, SMOKE_DIR)
    res = compare(df, duck, entry.oracle_sql()[name])
    assert res["columns_match"], res
    assert res["rows_match"] and res["values_match"], res


def _path_to_join(plan: str, table: str) -> list[list[str]]:
    """For each scan of ``table``: the operators between it and its nearest
    join (walking up the printed tree by indentation)."""
    lines = plan.splitlines()

    def depth(line: str) -> int:
        m = line.find("+-")
        return m if m >= 0 else len(line) - len(line.lstrip(" :"))

    paths = []
    for i, line in enumerate(lines):
        if "FileScan" in line and re.search(rf"[_/]{table}[\[\]]", line):
            d, path = depth(line), []
            for up in range(i - 1, -1, -1):
                if depth(lines[up]) < d:
                    d = depth(lines[up])
                    node = lines[up].strip(" :+-")
                    path.append(node.split(" ")[0])
                    if "Join" in node:
                        break
            paths.append(path)
    return paths


@pytest.mark.parametrize("name,table", [
    ("encounter_report", "transaction_distributions"),
    ("encounter_report", "patient_visit_procs_agg"),
    ("encounter_report", "patient_visit"),
    ("revenue_journal", "transaction_distributions"),
    ("revenue_journal", "patient_visit_procs_agg"),
    ("revenue_journal", "patient_visit"),
    ("visit_payments", "patient_visit"),
])
def test_cluster_plan_reads_big_facts_in_place(spark, name, table):
    """With size-based broadcast of facts off (as at cluster scale), the
    bucketed layout lets the big fact tables - and the visit history - meet
    their join partners without being shuffled."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(entry.queries()[name](spark, SMOKE_DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    paths = _path_to_join(plan, table)
    assert paths, f"no scan of {table}"
    for path in paths:
        assert path and "Join" in path[-1], path
        assert not any(p.startswith("Exchange") for p in path), path


def test_presentation_lists_match_spark_schemas(spark):
    """The oracle presents exactly the columns Spark returns as decimal or
    date (guards the engine-neutral comparison against drift)."""
    from pyspark.sql.types import DateType, DecimalType, TimestampNTZType, TimestampType

    from clinicledger.plans.registry import RAW_QUERIES
    from sqloracle.queries import PRESENTATION, TIMESTAMPS

    for name, query in RAW_QUERIES.items():
        schema = query(spark, SMOKE_DIR).schema
        dec = [f.name for f in schema.fields if isinstance(f.dataType, DecimalType)]
        dat = [f.name for f in schema.fields if isinstance(f.dataType, DateType)]
        ts = [f.name for f in schema.fields if isinstance(f.dataType, (TimestampNTZType, TimestampType))]
        assert (sorted(dec), sorted(dat)) == tuple(sorted(x) for x in PRESENTATION.get(name, ([], []))), name
        assert sorted(ts) == sorted(TIMESTAMPS.get(name, [])), name


def test_fixture_matches_measured_counts(spark, fixture_tables_small):
    """Counts FIXTURES.md section 3 records for sf0.001 (in brackets there)."""
    from pyspark.sql import functions as F

    from clinicledger.constants import EXCLUDED_TICKETS

    t = fixture_tables_small
    assert t.patient_visit_procs.count() == 6000
    assert t.patient_visit.count() == 1500
    assert t.transaction_distributions.count() == 18000
    assert t.patient_visit_resource.count() == 1684
    assert t.patient_visit_resource.groupBy("patient_visit_id").count().filter("count = 2").count() == 276
    assert t.patient_visit.filter(F.col("ticket_number").isin(list(EXCLUDED_TICKETS))).count() == 7
    assert t.patient_visit.filter(F.col("ticket_number").isNull()).count() == 15
    assert t.patient_visit_procs.join(t.batch, "batch_id", "left_anti").count() == 124
    assert t.patient_visit.filter(F.col("primary_insurance_carriers_id").isNull()).count() == 137
    window = t.patient_visit_procs.filter(
        (F.col("date_of_service_from") >= F.lit("1997-01-01").cast("timestamp_ntz"))
        & (F.col("date_of_service_from") < F.lit("1997-03-31 23:59:59.997").cast("timestamp_ntz"))
    )
    assert window.count() == 209


def test_key_range_prefilter_gives_same_reports(spark, fixture_tables_small):
    """The opt-in key-range pre-filter is exact and reaches the scans."""
    from clinicledger.operators.filters import KEY_RANGE_CONF
    from tests.conftest import rows

    t = fixture_tables_small
    plain = (rows(reports.encounter_report(t, ENCOUNTER)), rows(reports.revenue_journal(t, REVENUE)))
    spark.conf.set(KEY_RANGE_CONF, "true")
    try:
        enc = reports.encounter_report(t, ENCOUNTER)
        filtered = (rows(enc), rows(reports.revenue_journal(t, REVENUE)))
        plan = _plan(enc)
    finally:
        spark.conf.unset(KEY_RANGE_CONF)
    assert filtered == plain and len(plain[0]) > 0
    assert "GreaterThanOrEqual(patient_visit_procs_id" in plan
