"""The three report plans, composed from the operators.

* ``visit_payments``   - insurance payments per visit of one patient
* ``encounter_report`` - charge/payment ledger rolled up per ticket
* ``revenue_journal``  - one row per billed procedure line (times resource
  fan-out) with charges, classification, rate and collections to date

Each returns a lazy DataFrame; nothing runs until the caller's action.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicledger.constants import INCENTIVE_PATIENT_ID, SELF_PAY_LABEL, UNKNOWN_LABEL
from clinicledger.functions.classify import (
    broad_payer_type,
    effective_rate,
    resource_or_fallback,
    resource_type_or_fallback,
    service_type,
)
from clinicledger.functions.dates import day_of, in_window, month_of
from clinicledger.functions.money import adjustment_check_columns, charge_columns, money
from clinicledger.operators.closing import CloseSums, closed_totals
from clinicledger.operators.collections import collection_columns, collection_totals, window_visits
from clinicledger.operators.dims import (
    bounded_broadcast,
    dim,
    require_exists,
    with_carrier,
    with_providers,
)
from clinicledger.operators.filters import date_type_column, equals, optional_in, within_key_range
from clinicledger.operators.ledger import (
    REPORT_COLUMNS,
    charge_amounts,
    encounter_rollup,
    payment_amounts,
    stage_amounts,
)
from clinicledger.operators.resources import resource_label_by_assignment, visit_resource_profile
from clinicledger.operators.skew import VISIT, join_split
from clinicledger.plans.params import EncounterParams, RevenueParams
from clinicledger.sources.sinks import SORT_PREFIX, with_report_date
from clinicledger.sources.tables import Tables


def visit_payments(t: Tables, patient_id: str = INCENTIVE_PATIENT_ID) -> DataFrame:
    """``(visit, ins_payment)``: insurance payments of one patient summed per
    visit date. The patient filter reaches the profile scan; the matching
    profiles (a business key: a handful of rows, checked) are broadcast, so
    the patient's visits - possibly a large share of all - are never one
    shuffle partition."""
    pp = bounded_broadcast(equals(t.patient_profile, "patient_id", patient_id).select("patient_profile_id"))
    pva = t.patient_visit_agg.select("patient_visit_id", "patient_profile_id", "ins_payment")
    pv = t.patient_visit.select("patient_visit_id", "visit")
    return (
        pva.join(pp, "patient_profile_id")
        .join(pv, "patient_visit_id")
        .groupBy("visit")
        .agg(money(F.sum("ins_payment")).alias("ins_payment"))
    )


def encounter_ledger(t: Tables, p: EncounterParams) -> DataFrame:
    """Charge rows and payment rows in one staged ledger (bag union). The
    line amounts of both branches are unioned first and the visit
    attributes attached once (attaching is row-wise, so this equals
    ``build_ledger(charge_rows, payment_rows)`` with half the visit and
    profile joins)."""
    f = p.ledger_filter()
    return stage_amounts(charge_amounts(t, f).unionByName(payment_amounts(t, f)), t, f)


def _sort_columns(*names: str) -> list:
    """A report's sort keys under names that a sink drops."""
    return [F.col(c).alias(f"{SORT_PREFIX}{k}_{c}") for k, c in enumerate(names)]


def encounter_report(t: Tables, p: EncounterParams = EncounterParams(), sort_keys: bool = False) -> DataFrame:
    """Encounter report: the ledger summed per ticket, resource, type and
    procedure code, with clamped encounter counts. ``sort_keys`` adds the
    report's order for ``write_report``.

    Only the resource variant (``include_resource == 1``) has a definition;
    any other value yields an empty result of the same schema.
    """
    report = encounter_rollup(t, p.ledger_filter(), p.excluded_tickets, p.resources)
    if p.include_resource != 1:
        report = report.filter(F.lit(False))
    if p.ordered:
        # the report's order, then the remaining group keys: the result order
        # is still the report's, and a company or facility holding a large
        # share of the rows spreads over many range partitions
        report = report.orderBy("company_name", "facility_name", "ticket_number", *ORDER_TIE_BREAK)
    hidden = _sort_columns("company_name", "facility_name", "ticket_number", *ORDER_TIE_BREAK) if sort_keys else []
    return report.select(*REPORT_COLUMNS, *hidden)


# the remaining group keys of the rollup: together with the report's order
# they make the sort key unique per output row
ORDER_TIE_BREAK = ("date_of_service_from", "cpt_code", "hcpc", "resource", "resource_type", "resource_id",
                   "doctor_name", "patient_id", "policy_type", "insurance_carrier")


REVENUE_COLUMNS = [
    "ticket_number", "date_of_service", "month_of_service", "doctor_name", "resource",
    "provider_initials", "resource_type", "facility_name", "service_type", "policy_type",
    "primary_insurance_carrier", "broad_payer_type", "pps_rate", "cpt_code", "charges",
    "adjustments", "net_charges", "first_filed_date", "date_of_entry", "payments_to_date",
    "collectable_adjustments_to_date", "non_collectable_adjustments_to_date", "sum_adj_to_date",
    "adjustments_diff", "abs_adjustments_diff", "report_date",
]


def revenue_lines(t: Tables, p: RevenueParams, sums: CloseSums | None = None) -> DataFrame:
    """Procedure lines in the report window (date type's column, end + 1
    day) with their aggregate (joined on visit and line), collection totals
    (of the payment chain, or of the stored ``sums``) and the two line-level
    collection conditions (batch exists, service date in the closed window)."""
    col = date_type_column(p.date_type, "date_of_service_from", "date_of_entry")
    window = in_window(col, p.start, p.end, "end_plus_day") if col else F.lit(False)
    pvp = t.patient_visit_procs.select(
        "patient_visit_procs_id", "patient_visit_id", "batch_id", "cpt_code", "date_of_service_from",
        "date_of_entry",
    ).filter(window)
    pvpa = within_key_range(
        t.patient_visit_procs_agg.select(
            "patient_visit_procs_id", "patient_visit_id", "ins_allocation", "pat_allocation",
            "ins_adjustment", "pat_adjustment",
        ),
        pvp, "patient_visit_procs_id",
    )
    # Payments only matter for lines served inside the closed window: a
    # cheap pushed-down scan selects them for the payment chain.
    between = in_window("date_of_service_from", p.start, p.end, "bounded")
    served = pvp.filter(between)
    totals = (collection_totals(t, served, p.closing, p.cutoff) if sums is None
              else closed_totals(sums, served, p.closing, p.cutoff))
    batches = dim(t, "batch", ["batch_id"]).select("batch_id", F.lit(True).alias("batch_ok"))
    lines = (
        pvp.join(pvpa, ["patient_visit_id", "patient_visit_procs_id"])
        .join(totals, ["patient_visit_id", "patient_visit_procs_id"], "left")
        .join(batches, "batch_id", "left")
    )
    return lines.withColumn("in_closed_window", between)


def with_resource_copies(df: DataFrame) -> DataFrame:
    """Repeat each row ``resource_copies`` times (once when NULL: a visit
    without labels keeps one row)."""
    n = F.coalesce(F.col("resource_copies"), F.lit(1)).cast("int")
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), n))).drop("_copy", "resource_copies")


def revenue_visits(t: Tables, p: RevenueParams, with_resources: bool = True) -> DataFrame:
    """Per-visit context of the journal: doctor and facility (inner),
    carrier (inner) and policy type, whether the patient profile exists,
    the collections fan-out, and the resource rows (several per visit; one
    row with NULL labels for visits without)."""
    pv = t.patient_visit.select(
        "patient_visit_id", "patient_profile_id", "ticket_number", "doctor_id", "facility_id",
        "primary_insurance_carriers_id", "first_filed_date",
    )
    # only visits the window touches: read in place, before any shuffle
    in_window = window_visits(t, p.date_type, p.start, p.end)
    pv = require_exists(pv, in_window, "patient_visit_id")
    pv = optional_in(pv, "facility_id", p.facilities)
    pv = optional_in(pv, "primary_insurance_carriers_id", p.carriers)
    pv = with_providers(pv, t, {"doctor_id": "doctor_name", "facility_id": "facility_name"})
    pv = with_carrier(pv, t, "primary_insurance_carriers_id", how="inner",
                      names={"list_name": "carrier_name", "policy_type_mid": "policy_type_mid",
                             "policy_type": "policy_type_name"})
    profiles = t.patient_profile.select("patient_profile_id", F.lit(True).alias("profile_ok"))
    pv = pv.join(profiles, "patient_profile_id", "left")
    if p.fanout not in ("reference", "distinct"):
        raise ValueError(f"unknown fanout {p.fanout!r}")
    pv = pv.join(visit_resource_profile(t, within=in_window), "patient_visit_id", "left")
    if p.fanout == "distinct":
        pv = pv.withColumn("fanout", F.when(F.col("fanout").isNotNull(), F.lit(1).cast("bigint")))
    if not with_resources:
        return pv.drop("resource_copies")
    # The report joins the visit resources a second time, which repeats every
    # label row by their number; the copies are generated from that count at
    # the end (``with_resource_copies``) instead of a join that pairs the
    # visit's resources with each other.
    labels = resource_label_by_assignment(t).select(
        "patient_visit_id", "dot_id", "resource_name", F.col("resource_type").alias("label_type")
    )
    pv = pv.join(labels, "patient_visit_id", "left")
    return pv.withColumn("resource_copies", F.when(F.col("label_type").isNotNull(), F.col("resource_copies")))


def revenue_journal(t: Tables, p: RevenueParams, sort_keys: bool = False, sums: CloseSums | None = None) -> DataFrame:
    """Revenue journal entry report (26 columns). ``sort_keys`` adds the
    report's order for ``write_report``; with ``sums`` (``closing``) another
    accounting close doesn't walk the payment chain again."""
    lines = join_split(t, revenue_lines(t, p, sums), revenue_visits(t, p), VISIT)
    # a line has collections when its batch exists, it was served in the
    # closed window, its patient exists and its visit has counted resources
    eligible = (
        F.col("batch_ok").isNotNull() & F.col("in_closed_window")
        & F.col("profile_ok").isNotNull() & F.col("fanout").isNotNull()
    )
    lines = lines.withColumns(collection_columns(eligible, F.col("fanout")))
    charges = F.col("ins_allocation") + F.col("pat_allocation")
    amounts = charge_columns()
    checks = adjustment_check_columns(F.col("ins_adjustment") + F.col("pat_adjustment"))
    out = lines.select(
        "ticket_number",
        day_of("date_of_service_from").alias("date_of_service"),
        month_of("date_of_service_from").alias("month_of_service"),
        "doctor_name",
        resource_or_fallback("resource_name", "doctor_name", charges).alias("resource"),
        F.col("dot_id").alias("provider_initials"),
        resource_type_or_fallback("label_type", "doctor_name", charges).alias("resource_type"),
        "facility_name",
        service_type("label_type", charges).alias("service_type"),
        F.coalesce(F.col("policy_type_name"), F.lit(UNKNOWN_LABEL)).alias("policy_type"),
        F.coalesce(F.col("carrier_name"), F.lit(SELF_PAY_LABEL)).alias("primary_insurance_carrier"),
        broad_payer_type("policy_type_mid").alias("broad_payer_type"),
        effective_rate("date_of_service_from", p.rates).alias("pps_rate"),
        "cpt_code",
        *[amounts[c].alias(c) for c in ("charges", "adjustments", "net_charges")],
        day_of("first_filed_date").alias("first_filed_date"),
        day_of("date_of_entry").alias("date_of_entry"),
        money("payments").alias("payments_to_date"),
        *[checks[c].alias(c) for c in (
            "collectable_adjustments_to_date", "non_collectable_adjustments_to_date", "sum_adj_to_date",
            "adjustments_diff", "abs_adjustments_diff")],
        "date_of_service_from",
        "patient_visit_id",
        "patient_visit_procs_id",
        "resource_copies",
    )
    out = with_report_date(out, p.report_date)
    if p.ordered:
        # service time and visit as in the report; the line id only breaks
        # ties so that a hot visit spreads over range partitions
        out = out.orderBy("date_of_service_from", "patient_visit_id", "patient_visit_procs_id")
    # the reference's duplicate rows share their line's sort key and are
    # generated per row after the sort (order kept; the sort's sampling and
    # shuffle see each label row once)
    hidden = _sort_columns("date_of_service_from", "patient_visit_id", "patient_visit_procs_id") if sort_keys else []
    return with_resource_copies(out).select(*REVENUE_COLUMNS, *hidden)
