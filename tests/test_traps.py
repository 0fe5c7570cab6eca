"""Report-level traps on a hand-built practice (expected values written from
the report semantics)."""

from __future__ import annotations

import dataclasses
import datetime as dt
from decimal import Decimal as Dec

import pytest

from clinicledger.plans import reports
from clinicledger.plans.params import EncounterParams, RevenueParams

D = dt.datetime
SVC = D(1997, 2, 10, 9)
SVC2 = D(1997, 2, 10, 15)


def world(make_tables, **over):
    """One practice: doctor 1, facility 1000 (office), company 2000;
    visit 100 (two resources with one provider type each, carrier 5),
    visit 200 (no resources, no carrier); procedure lines on both."""
    base = dict(
        patient_profile=[(7, "7", "Smith")],
        patient_visit=[
            (100, 7, "000100", 1, 1000, 2000, 5, SVC, SVC, SVC),
            (200, 7, "000200", 1, 1000, 2000, None, SVC, SVC, None),
        ],
        doctor_facility=[(1, "Dr One", "D1", None), (3, "Dr Three", "D3", None),
                         (1000, "Fac", None, 300), (2000, "Co", None, None)],
        med_lists=[(300, "Office", "11", None), (2400, "Doctors", None, None), (2401, "BHC", None, None),
                   (400, "HCPC - MED", None, None), (2495, "Medicaid", None, None), (600, "Adj", None, "Y")],
        insurance_carriers=[(5, "Carrier A", 2495)],
        procedures=[(7, 500, 400)],
        batch=[(1,), (2,)],
        patient_visit_procs=[
            (10, 100, 7, 1, "99213", "99213", 1.0, SVC, SVC, Dec("100.00")),
            (11, 100, 7, 1, "99213", "99213", 1.0, SVC2, SVC2, Dec("50.00")),
            (20, 200, 7, 2, "99213", "99213", 1.0, SVC, SVC, Dec("80.00")),
        ],
        patient_visit_procs_agg=[
            (10, 100, Dec("100.00"), Dec("0.00"), Dec("10.00"), Dec("0.00"), Dec("100.00"), Dec("0.00")),
            (11, 100, Dec("50.00"), Dec("0.00"), Dec("5.00"), Dec("0.00"), Dec("50.00"), Dec("0.00")),
            (20, 200, Dec("80.00"), Dec("0.00"), Dec("8.00"), Dec("0.00"), Dec("80.00"), Dec("0.00")),
        ],
        patient_visit_resource=[(1, 100, 1), (2, 100, 3)],
        resource_type_assignments=[(1, 2400), (3, 2401)],
        payment_method=[(50, 2, 2, "CK1", D(1997, 2, 20), "Insurance", D(1997, 4, 2))],
        visit_transactions=[(70, 100, 50)],
        transactions=[(80, 70, "P", None), (81, 70, "A", 600)],
        transaction_distributions=[(80, 10, Dec("60.00")), (81, 10, Dec("10.00"))],
    )
    base.update(over)
    return make_tables(**base)


ENC = EncounterParams(start=D(1997, 1, 1), end=D(1997, 3, 31, 23, 59, 59, 997000), ordered=False)
REV = RevenueParams(start=D(1997, 1, 1), end=D(1997, 12, 31), closing=D(1997, 12, 31), cutoff=dt.date(1997, 12, 31),
                    report_date=D(1998, 1, 15), ordered=False)


def test_t13_journal_repeats_lines_per_label_and_visit_resource(make_tables):
    # visit 100: two labels (one per visit resource) x two visit resources = 4 rows per line
    rj = reports.revenue_journal(world(make_tables), REV)
    got = sorted((r.date_of_service, r.resource, r.charges) for r in rj.collect())
    assert len(got) == 8  # lines 10 and 11, 4 rows each; visit 200 has no carrier (T20)
    assert sorted({r[1] for r in got}) == ["Dr One", "Dr Three"]


def test_t20_carrier_inner_in_journal_left_in_encounters(make_tables):
    t = world(make_tables)
    rj_tickets = {r.ticket_number for r in reports.revenue_journal(t, REV).collect()}
    assert rj_tickets == {"000100"}
    # encounter report: visit 200 has no resources, so give it one to see the carrier default
    t2 = world(make_tables, patient_visit_resource=[(1, 100, 1), (2, 100, 3), (3, 200, 1)])
    enc = {r.ticket_number: r.insurance_carrier for r in reports.encounter_report(t2, ENC).collect()}
    assert enc["000200"] == "Self Pay" and enc["000100"] == "Carrier A"


def test_t21_lines_without_collections(make_tables):
    # no resources on visit 100 -> no collections row: payments NULL, components 0, sums NULL
    t = world(make_tables, patient_visit_resource=[], resource_type_assignments=[])
    r = reports.revenue_journal(t, REV).filter("cpt_code = '99213'").collect()[0]
    assert r.payments_to_date is None and r.sum_adj_to_date is None and r.adjustments_diff is None
    assert r.collectable_adjustments_to_date == Dec("0.00") and r.non_collectable_adjustments_to_date == Dec("0.00")
    assert r.resource == "None/Error" and r.service_type == "Other/Error"


def test_t12_collections_counted_per_assignment_in_journal(make_tables):
    # visit 100 has two counted assignments -> each payment counts twice
    rows = reports.revenue_journal(world(make_tables), REV).filter("payments_to_date IS NOT NULL").collect()
    line10 = {(r.payments_to_date, r.collectable_adjustments_to_date) for r in rows if r.charges == Dec("100.00")}
    assert line10 == {(Dec("120.00"), Dec("20.00"))}
    distinct = dataclasses.replace(REV, fanout="distinct")
    rows = reports.revenue_journal(world(make_tables), distinct).filter("charges = 100").collect()
    assert {r.payments_to_date for r in rows} == {Dec("60.00")}


def test_t29_same_day_lines_stay_apart(make_tables):
    rep = reports.encounter_report(world(make_tables), ENC).filter("ticket_number = '000100'").collect()
    # two lines at 09:00 and 15:00 on one day: two look-alike rows per resource/type
    per_day = [(r.date_of_service, r.resource_type) for r in rep]
    assert sorted(per_day) == sorted([(SVC.date(), "Doctors"), (SVC.date(), "Doctors"),
                                      (SVC.date(), "BHC"), (SVC.date(), "BHC")])
    assert {r.ov_encounter for r in rep} == {1} and {r.count_enc for r in rep} == {1}


def test_t2_doe_payments_use_payment_entry_date(make_tables):
    # payment entered 1997-04-02: outside a Q1 'DOE' window, inside for Q2
    t = world(make_tables)
    q1 = dataclasses.replace(ENC, date_type="DOE")
    assert all(r.ins_payment == Dec("0.00") for r in reports.encounter_report(t, q1).collect())
    # Q2 DOE: the charge lines are not entered in Q2 and the service-date clause
    # (Q2) drops them too, so nothing is reported
    q2 = dataclasses.replace(ENC, date_type="DOE", start=D(1997, 4, 1), end=D(1997, 6, 30, 23, 59, 59, 997000))
    assert reports.encounter_report(t, q2).count() == 0


@pytest.mark.parametrize("batches,charge_lines,payments", [
    ((1,), 2, Dec("60.00")),   # procedure batch 1 (lines 10, 11); payment method batch 2 -> no payments
    ((2,), 0, Dec("60.00")),   # payment method batch 2: payment rows only
])
def test_t30_batch_filter_tests_each_branch_own_batch(make_tables, batches, charge_lines, payments):
    from clinicledger.operators import ledger

    t = world(make_tables)
    f = dataclasses.replace(ENC, batches=batches).ledger_filter()
    charges = ledger.charge_rows(t, f).filter("patient_visit_id = 100").count()
    pays = ledger.payment_rows(t, f).collect()
    assert charges == charge_lines
    total = sum((r.ins_payment for r in pays), Dec("0.00"))
    assert total == (payments if 2 in batches else Dec("0.00"))


def test_t26_report_money_types(make_tables):
    rep = reports.encounter_report(world(make_tables), ENC)
    types = dict(rep.dtypes)
    assert types["charges"] == "decimal(18,2)" and types["count_enc"] == "bigint"
    rj = reports.revenue_journal(world(make_tables), REV)
    assert dict(rj.dtypes)["payments_to_date"] == "decimal(18,2)"
