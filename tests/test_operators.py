"""Operators on hand-written rows; expected rows are written from the report
semantics, not from the code."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as Dec

from pyspark.sql import functions as F

from clinicledger.operators import collections as coll
from clinicledger.operators import dims, filters, ledger, resources
from tests.conftest import rows

D = dt.datetime


# --- filters ---------------------------------------------------------------------

def test_exclude_keys_drops_null_keys(spark):
    # T3: NOT IN drops NULL tickets; a plain anti join would keep them
    df = spark.createDataFrame([(1, "000347"), (2, "000348"), (3, None)], "id int, ticket string")
    assert rows(filters.exclude_keys(df, "ticket", ["000347"]), "id") == [(2,)]
    keys = spark.createDataFrame([("000347",), (None,)], "k string")
    assert rows(filters.exclude_keys(df, "ticket", keys), "id") == [(2,)]


def test_exclude_keys_long_list_uses_anti_join(spark):
    df = spark.createDataFrame([(i, f"{i:06d}") for i in range(20)] + [(99, None)], "id int, ticket string")
    excluded = [f"{i:06d}" for i in range(0, 20, 2)] + [f"x{i}" for i in range(filters.INLINE_LIST_MAX)]
    out = filters.exclude_keys(df, "ticket", excluded)
    assert rows(out, "id") == [(i,) for i in range(1, 20, 2)]
    assert "Anti" in out._jdf.queryExecution().executedPlan().toString()


def test_optional_in_unset_adds_no_predicate(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, doctor int")
    assert filters.optional_in(df, "doctor", None) is df
    assert rows(filters.optional_in(df, "doctor", [20, 30]), "id") == [(2,)]


def test_nonzero_and_drop_values_drop_nulls(spark):
    df = spark.createDataFrame([(1, Dec("0.00"), 2400), (2, Dec("1.00"), 2460), (3, None, None)],
                               "id int, amount decimal(10,2), type bigint")
    assert rows(filters.nonzero(df, "amount"), "id") == [(2,)]
    assert rows(filters.drop_values(df, "type", [2460, 2461, 2452]), "id") == [(1,)]


def test_date_window_unknown_date_type_selects_nothing(spark):
    df = spark.createDataFrame([(D(1997, 1, 2),)], "ts timestamp_ntz")
    col = filters.date_type_column("XYZ", "ts", "ts")
    assert filters.date_window(df, col, None, None).count() == 0


# --- dims -----------------------------------------------------------------------

def test_bounded_broadcast(spark):
    small = spark.range(5)
    assert dims.rows_at_most(small, 5) and not dims.rows_at_most(small, 4)
    plan = small.join(dims.bounded_broadcast(spark.range(3)), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan


def test_lookup_left_keeps_unmatched_and_defaults(spark, make_tables):
    t = make_tables(med_lists=[(1, "Medicaid", None, None)])
    df = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, policy bigint")
    out = dims.with_defaults(dims.with_medlist(df, t, "policy", {"description": "policy_type"}),
                             {"policy_type": "Unknown"})
    assert rows(out, "id", "policy_type") == [(10, "Medicaid"), (11, "Unknown"), (12, "Unknown")]


def test_require_exists_never_multiplies(spark):
    df = spark.createDataFrame([(1, 7), (2, 8)], "id int, batch bigint")
    keys = spark.createDataFrame([(7,), (7,)], "batch bigint")
    assert rows(dims.require_exists(df, keys, "batch"), "id") == [(1,)]


# --- resources (T16) -----------------------------------------------------------------

def _resource_tables(make_tables):
    return make_tables(
        doctor_facility=[(1, "Dr One", "D1", None), (2, "Dr Two", "D2", None), (3, None, "D3", None)],
        med_lists=[(2400, "Doctors", None, None), (2401, "BHC", None, None), (2404, "Nurses", None, None),
                   (2460, "Prenatal Provider", None, None)],
        resource_type_assignments=[(1, 2400), (1, 2401), (2, 2404), (2, 2460), (3, 2400)],
        # visit 100: one resource with two provider types; 200: two resources; 300: none;
        # 400: resource with no provider type; 500: resource without a name
        patient_visit_resource=[(1001, 100, 1), (2001, 200, 1), (2002, 200, 2), (4001, 400, 2), (5001, 500, 3)],
    )


def test_label_by_visit_counts_resources(make_tables):
    t = _resource_tables(make_tables)
    got = rows(resources.resource_label_by_visit(t))
    assert got == [(100, "Dr One"), (200, "(Multiple)"), (400, "Dr Two"), (500, None)]


def test_label_by_assignment_counts_provider_types(make_tables):
    t = _resource_tables(make_tables)
    got = rows(resources.resource_label_by_assignment(t))
    assert got == [
        (100, 1001, "D1", "(Multiple)", "Doctors"),
        (200, 2001, "D1", "(Multiple)", "Doctors"),
        (500, 5001, "D3", None, "Doctors"),
    ]


def test_fanout_counts_assignments_not_excluded(make_tables):
    # T12: (resource x type) rows per visit, types 2460/2461/2452 left out
    t = _resource_tables(make_tables)
    assert rows(resources.resource_fanout(t)) == [(100, 2), (200, 3), (400, 1), (500, 1)]


def test_expand_resources_keeps_duplicates(spark, make_tables):
    t = _resource_tables(make_tables)
    df = spark.createDataFrame([(200, "x")], "patient_visit_id bigint, v string")
    got = rows(resources.expand_resources(df, t), "resource_id", "resource_type")
    assert got == [(1, "BHC"), (1, "Doctors")]


# --- ledger ---------------------------------------------------------------------------

def test_route_payments_by_source_and_action(spark):
    data = [(s, a, Dec("10.00")) for s in (1, 2, 3, None) for a in ("P", "A", "T", None)]
    df = spark.createDataFrame(data, "source int, action string, amount decimal(10,2)")
    routed = ledger.route_payments()
    out = df.select("source", "action", *[routed[c].cast("decimal(10,2)").alias(c) for c in routed]).collect()
    z, p, m = Dec("0.00"), Dec("10.00"), Dec("-10.00")
    expect = {
        (1, "P"): (m, z, z, p, z, z), (1, "A"): (m, z, z, z, z, p),
        (2, "P"): (z, m, p, z, z, z), (2, "A"): (z, m, z, z, p, z),
    }
    for r in out:
        assert tuple(r)[2:] == expect.get((r.source, r.action), (z,) * 6), (r.source, r.action)


def test_ledger_balance_invariant(fixture_tables_small):
    # balance = allocation - payment - adjustment, per charge row (before the
    # flat-rate reclass) and per payment row with action A or P
    from clinicledger.plans.registry import ENCOUNTER

    t, f = fixture_tables_small, ENCOUNTER.ledger_filter()
    charges = ledger.charge_rows(t, f)
    bad = charges.filter(
        (F.col("ins_balance") + F.col("pat_balance"))
        != (F.col("ins_allocation") + F.col("pat_allocation") - F.col("ins_adjustment") - F.col("pat_adjustment"))
    )
    assert charges.count() > 0 and bad.count() == 0
    pays = ledger.payment_rows(t, f)
    bad = pays.filter(
        (F.col("ins_balance") + F.col("pat_balance"))
        != -(F.col("ins_payment") + F.col("pat_payment") + F.col("ins_adjustment") + F.col("pat_adjustment"))
    )
    assert pays.count() > 0 and bad.count() == 0
    union = ledger.build_ledger(charges, pays)
    assert union.count() == charges.count() + pays.count()


def test_rollup_count_enc_is_sum_of_clamps(fixture_tables_small):
    from clinicledger.plans import reports
    from clinicledger.plans.registry import ENCOUNTER

    rep = reports.encounter_report(fixture_tables_small, ENCOUNTER)
    bad = rep.filter(F.col("count_enc") != F.col("ov_encounter") + F.col("inpatient_encounter")
                     + F.col("other_encounter") + F.col("home_encounter"))
    assert rep.count() > 0 and bad.count() == 0
    assert rep.filter((F.col("ov_encounter") > 1) | (F.col("ov_encounter") < -1)).count() == 0


# --- collections (T12, T15) ------------------------------------------------------------

def _collection_tables(make_tables):
    svc = D(1997, 2, 1, 9)
    return make_tables(
        patient_profile=[(7, "7", "Smith")],
        patient_visit=[(100, 7, "000100", 1, 1000, 2000, 5, svc, svc, None)],
        doctor_facility=[(1, "Dr One", "D1", None), (2, "Dr Two", "D2", None), (1000, "Fac", None, None)],
        med_lists=[(2400, "Doctors", None, None), (2401, "BHC", None, None), (600, "Adj", None, "Y"),
                   (601, "WO", None, "N")],
        batch=[(1,)],
        patient_visit_procs=[(10, 100, 5, 1, "99213", "99213", 1.0, svc, svc, Dec("100.00"))],
        patient_visit_procs_agg=[(10, 100, Dec("60.00"), Dec("40.00"), Dec("5.00"), Dec("3.00"),
                                  Dec("60.00"), Dec("40.00"))],
        # two resources, the first with two types -> fan-out 3
        patient_visit_resource=[(1, 100, 1), (2, 100, 2)],
        resource_type_assignments=[(1, 2400), (1, 2401), (2, 2400)],
        payment_method=[(50, 1, 2, "CK1", svc, "Insurance", svc), (51, 1, 1, "CK2", svc, "Patient", svc)],
        visit_transactions=[(70, 100, 50), (71, 100, 51)],
        transactions=[(80, 70, "P", None), (81, 70, "A", 600), (82, 71, "P", None), (83, 71, "A", 601)],
        transaction_distributions=[(80, 10, Dec("30.00")), (81, 10, Dec("5.00")), (82, 10, Dec("20.00")),
                                   (83, 10, Dec("3.00"))],
    )


def test_collections_fanout_reference_and_distinct(make_tables):
    t = _collection_tables(make_tables)
    args = ("DOS", D(1997, 1, 1), D(1997, 12, 31), D(1997, 12, 31), dt.date(1997, 12, 31))
    ref = rows(coll.collections(t, *args))
    one = rows(coll.collections(t, *args, fanout="distinct"))
    assert one == [(100, 10, "99213", Dec("50.00"), Dec("5.00"), Dec("3.00"))]
    assert ref == [(100, 10, "99213", Dec("150.00"), Dec("15.00"), Dec("9.00"))]


def test_collections_need_resources_and_closed_window(make_tables):
    t = _collection_tables(make_tables)
    # T17: service on the last day after midnight -> no collections row
    args = ("DOS", D(1997, 1, 1), D(1997, 2, 1), D(1997, 12, 31), dt.date(1997, 12, 31))
    assert coll.collections(t, *args).count() == 0
    # no counted resource assignment -> no collections row
    t2 = _collection_tables(make_tables)
    t2 = t2.__class__(**{**{n: t2.table(n) for n in t2.names()},
                         "patient_visit_resource": t2.patient_visit_resource.limit(0)})
    args = ("DOS", D(1997, 1, 1), D(1997, 12, 31), D(1997, 12, 31), dt.date(1997, 12, 31))
    assert coll.collections(t2, *args).count() == 0


def test_pivot_payments_routes_six_ways(make_tables):
    t = _collection_tables(make_tables)
    out = coll.pivot_payments(coll.payment_lines(t), t).first()
    assert (out.insurance_payment, out.patient_payment, out.collectable_insurance_adjustment,
            out.non_collectable_insurance_adjustment, out.collectable_patient_adjustment,
            out.non_collectable_patient_adjustment) == (
        Dec("30.00"), Dec("20.00"), Dec("5.00"), Dec("0.00"), Dec("0.00"), Dec("3.00"))


# --- sinks and optional filters ---------------------------------------------------

def test_write_report_partitions_by_month(spark, tmp_path, fixture_tables_small):
    from clinicledger.plans import reports
    from clinicledger.plans.registry import REVENUE
    from clinicledger.sources import sinks
    import dataclasses

    rep = reports.revenue_journal(fixture_tables_small, dataclasses.replace(REVENUE, ordered=False))
    out = str(tmp_path / "journal")
    sinks.write_report(rep, out, sort_by=("date_of_service", "ticket_number"))
    back = sinks.read_report(spark, out)
    assert back.count() == rep.count()
    months = {r[0] for r in back.select("month_of_service").distinct().collect()}
    assert months and all(len(m) == 7 for m in months)
    pruned = back.filter(sinks.month_partition_filter(dt.date(1997, 2, 1), dt.date(1997, 3, 31)))
    assert "PartitionFilters" in pruned._jdf.queryExecution().executedPlan().toString()


def test_void_visits_filter(spark):
    df = spark.createDataFrame([(1, "Office visit"), (2, "*VOID* visit"), (3, None)], "id int, d string")
    assert rows(filters.exclude_void_visits(df, "d"), "id") == [(1,)]


def test_store_and_open_in_report_layout(spark, tmp_path, fixture_tables_small):
    from clinicledger.plans import reports
    from clinicledger.plans.registry import ENCOUNTER
    from clinicledger.sources import store

    target = str(tmp_path / "stored")
    stored = store.store_tables(fixture_tables_small, target, buckets=4)
    assert store.is_stored(spark, target)
    reopened = store.open_stored(spark, target)
    a = reports.encounter_report(stored, ENCOUNTER)
    b = reports.encounter_report(reopened, ENCOUNTER)
    assert rows(a) == rows(b) and len(rows(a)) > 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = reopened.transaction_distributions.join(reopened.patient_visit_procs_agg, "patient_visit_procs_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan


def test_cli_runs_reports(spark, tmp_path, fixture_tables_small, capsys):
    from clinicledger.__main__ import main
    from clinicledger.sources import store

    target = str(tmp_path / "stored")
    store.store_tables(fixture_tables_small, target, buckets=4)
    assert main(["encounter", "--tables", target, "--start", "1997-01-01", "--end", "1997-03-31T23:59:59.997",
                 "--show", "3"]) == 0
    out_dir = str(tmp_path / "journal")
    assert main(["revenue", "--tables", target, "--as-of", "1998-01-15", "--closing", "1997-06-30T12:00",
                 "--cutoff", "1997-12-31", "--rate-shift-years", "-20", "--out", out_dir]) == 0
    assert spark.read.parquet(out_dir).count() > 0
    assert main(["visit-payments", "--tables", target, "--patient-id", "48"]) == 0
    assert "ticket_number" in capsys.readouterr().out


def test_cli_store_from_plain_parquet(spark, tmp_path, fixture_tables_small):
    from clinicledger.__main__ import main
    from clinicledger.plans import reports
    from clinicledger.sources import store
    from clinicledger.sources.tables import Tables

    src, dst = str(tmp_path / "plain"), str(tmp_path / "layout")
    for name in Tables.names():
        fixture_tables_small.table(name).write.parquet(f"{src}/{name}")
    assert main(["store", "--source", src, "--target", dst, "--buckets", "4"]) == 0
    t = store.open_stored(spark, dst)
    assert rows(reports.visit_payments(t, "48")) == rows(reports.visit_payments(fixture_tables_small, "48"))


def test_ledger_text_lengths(spark, fixture_tables_small):
    # S4: the staged ledger fits the staging table's declared varchar lengths
    from clinicledger.plans.registry import ENCOUNTER

    t, f = fixture_tables_small, ENCOUNTER.ledger_filter()
    staged = ledger.build_ledger(ledger.charge_rows(t, f), ledger.payment_rows(t, f))
    assert ledger.ledger_length_violations(staged).count() == 0
    long_ticket = staged.limit(1).withColumn("ticket_number", F.lit("x" * 36))
    assert ledger.ledger_length_violations(long_ticket).count() == 1


def test_cli_store_rejects_duplicate_keys(spark, tmp_path, fixture_tables_small):
    import pytest

    from clinicledger.__main__ import main
    from clinicledger.sources.tables import Tables

    src, dst = str(tmp_path / "plain"), str(tmp_path / "layout")
    for name in Tables.names():
        df = fixture_tables_small.table(name)
        if name == "patient_visit":
            df = df.unionByName(df.limit(1))  # one visit id twice
        df.write.parquet(f"{src}/{name}")
    with pytest.raises(ValueError, match="patient_visit"):
        main(["store", "--source", src, "--target", dst, "--buckets", "4"])
