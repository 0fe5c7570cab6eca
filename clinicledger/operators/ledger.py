"""The encounter report's charge and payment ledger.

Charge rows (one per procedure line) and payment rows (one per non-zero
payment distribution) are staged in one typed ledger and rolled up per
ticket, resource and procedure code.

Two ways to the same rollup:

* ``charge_rows`` / ``payment_rows`` / ``build_ledger`` / ``rollup_ledger``
  stage the full ledger (every row carries its visit's attributes) and roll
  it up - the staged ledger as an inspectable table.
* ``encounter_rollup`` (what the report runs) aggregates first: line-level
  amounts are summed per (visit, service time, code, qualifier) with
  map-side partial aggregation, *then* joined to the visits (read in place),
  profiles and dimensions, then to the resource fan-out and labels, then
  rolled up. Sums are additive and everything joined later is constant per
  visit, so this is exact (encounter flags factor as
  ``place_ok ? sum(line flags) : 0``). A visit, code or payment method
  holding a third of all rows is collapsed map-side before its shuffle,
  and only window-sized rows ever meet the visit and profile tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicledger.constants import (
    ACTION_ADJUSTMENT,
    ACTION_PAYMENT,
    DATA_SOURCE,
    HOME_POS,
    INPATIENT_POS,
    LEDGER_TEXT_LENGTHS,
    NO_CODE_LABEL,
    NONE_LABEL,
    NOT_OTHER_POS,
    OFFICE_POS,
    SELF_PAY_LABEL,
    SOURCE_INSURANCE,
    SOURCE_PATIENT,
    TEST_PATIENT_MARKERS,
    UNKNOWN_LABEL,
)
from clinicledger.functions.dates import in_window, month_of
from clinicledger.functions.money import (
    LEDGER_MONEY,
    clamp_unit,
    flat_rate_ins_adjustment,
    flat_rate_ins_allocation,
    line_encounter,
    money,
    place_flag,
    place_in,
    place_not_in,
)
from clinicledger.functions.text import text_equals
from clinicledger.operators.dims import (
    dim,
    lookup,
    require_exists,
    with_carrier,
    with_defaults,
    with_facility,
    with_medlist,
    with_providers,
)
from clinicledger.operators.filters import (
    date_type_column,
    exclude_keys,
    exclude_test_patients,
    optional_in,
    within_key_range,
)
from clinicledger.operators.resources import resource_label_by_visit, visit_resource_types
from clinicledger.operators.skew import TRANSACTION, VISIT, VISIT_TRANSACTION, join_split, join_stored
from clinicledger.sources.tables import Tables


@dataclass(frozen=True)
class LedgerFilter:
    """The parts of the encounter parameters the ledger branches read."""

    start: dt.datetime | None
    end: dt.datetime | None
    date_type: str = "DOS"
    doctors: Sequence[int] | None = None
    procedures: Sequence[int] | None = None
    facilities: Sequence[int] | None = None
    companies: Sequence[int] | None = None
    carriers: Sequence[int] | None = None
    # applies to the procedure line's batch for charges and to the payment
    # method's batch for payments
    batches: Sequence[int] | None = None
    test_patient_markers: Sequence[str] = TEST_PATIENT_MARKERS
    ignore_case: bool = True


# Staged ledger: the columns the rollup reads, with their types. Unread
# staging columns (ids, Flag, Entry, POS, department, ...) are not carried.
LEDGER_SCHEMA = {
    "patient_visit_id": "bigint",
    "doctor_name": "string",
    "facility_name": "string",
    "company_name": "string",
    "policy_type": "string",
    "insurance_carrier": "string",
    "ins_allocation": LEDGER_MONEY,
    "pat_allocation": LEDGER_MONEY,
    "pat_balance": LEDGER_MONEY,
    "ins_balance": LEDGER_MONEY,
    "ins_payment": LEDGER_MONEY,
    "pat_payment": LEDGER_MONEY,
    "ins_adjustment": LEDGER_MONEY,
    "pat_adjustment": LEDGER_MONEY,
    "cpt_code": "string",
    "ticket_number": "string",
    "date_of_service_from": "timestamp_ntz",
    "month_of_service": "string",
    "ov_encounter": "int",
    "inpatient_encounter": "int",
    "other_encounter": "int",
    "home_encounter": "int",
    "patient_id": "string",
    "hcpc": "string",
}
LEDGER_MONEY_COLUMNS = [c for c, ty in LEDGER_SCHEMA.items() if ty == LEDGER_MONEY]
ENCOUNTER_COLUMNS = ["ov_encounter", "inpatient_encounter", "other_encounter", "home_encounter"]
# Ledger group keys (besides the visit) of the rollup.
LEDGER_KEYS = [
    "doctor_name",
    "facility_name",
    "company_name",
    "policy_type",
    "insurance_carrier",
    "ticket_number",
    "date_of_service_from",
    "month_of_service",
    "patient_id",
    "cpt_code",
    "hcpc",
]


def to_ledger(df: DataFrame) -> DataFrame:
    """Cast rows to the staged ledger schema (money rounds to cents per row)."""
    return df.select([F.col(c).cast(ty).alias(c) for c, ty in LEDGER_SCHEMA.items()])


def ledger_length_violations(ledger: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Staged rows whose text exceeds the staging table's declared length
    (DataFrames do not enforce ``varchar(n)``; the staging insert would
    reject such rows). A filter, so it runs distributed; an empty result
    means the ledger fits."""
    limits = limits or LEDGER_TEXT_LENGTHS
    too_long = None
    for col, n in limits.items():
        cond = F.length(F.col(col)) > n
        too_long = cond if too_long is None else (too_long | cond)
    return ledger.filter(too_long)


def build_ledger(charges: DataFrame, payments: DataFrame) -> DataFrame:
    """Bag union of the two staged row sets (duplicates kept)."""
    return to_ledger(charges).unionByName(to_ledger(payments))


def join_visits(df: DataFrame, t: Tables, f: LedgerFilter) -> DataFrame:
    """Attach the visit's ids of profile, doctor, facility, company and
    carrier and its ticket to rows keyed by ``patient_visit_id``, keeping
    visits that pass the optional lists. The rows meet the visits read in
    place on the visit bucketing."""
    pv = t.patient_visit.select(
        "patient_visit_id", "patient_profile_id", "ticket_number", "doctor_id",
        "facility_id", "company_id", "primary_insurance_carriers_id",
    )
    pv = optional_in(pv, "doctor_id", f.doctors)
    pv = optional_in(pv, "facility_id", f.facilities)
    pv = optional_in(pv, "company_id", f.companies)
    pv = optional_in(pv, "primary_insurance_carriers_id", f.carriers)
    return join_split(t, df, pv, VISIT)


def join_profiles_and_dims(df: DataFrame, t: Tables, f: LedgerFilter) -> DataFrame:
    """Keep rows of non-test patients (profile join) and resolve the visit's
    ids to names through broadcast dimensions: providers by role, facility
    with its place of service, carrier with its policy type."""
    pp = exclude_test_patients(
        t.patient_profile.select("patient_profile_id", "patient_id", "last"), "last",
        f.test_patient_markers, f.ignore_case,
    ).drop("last")
    v = df.join(pp, "patient_profile_id")
    v = with_providers(v, t, {"doctor_id": "doctor_name", "company_id": "company_name"})
    v = with_facility(v, t, "facility_id", "facility_name", "pos_code")
    v = with_carrier(v, t, "primary_insurance_carriers_id")
    v = with_defaults(v, {"policy_type": UNKNOWN_LABEL, "insurance_carrier": SELF_PAY_LABEL,
                          "patient_id": UNKNOWN_LABEL})
    return v.drop("patient_profile_id", "doctor_id", "facility_id", "company_id",
                  "primary_insurance_carriers_id", "policy_type_mid")


def with_visit_attributes(df: DataFrame, t: Tables, f: LedgerFilter) -> DataFrame:
    """Attach to rows keyed by ``patient_visit_id`` the visit attributes
    both ledger branches carry (ticket, providers by role, carrier, policy
    type, place of service, patient id), keeping only visits of non-test
    patients that pass the optional lists. The rows (window-sized) meet the
    visits first, read in place, so only window rows are shuffled after."""
    return join_profiles_and_dims(join_visits(df, t, f), t, f)


def procedure_lines(t: Tables, window_pred, f: LedgerFilter) -> DataFrame:
    """Procedure lines passing ``window_pred`` with their qualifier
    description (procedure -> qualifier lookups are left joins)."""
    pvp = t.patient_visit_procs.select(
        "patient_visit_procs_id", "patient_visit_id", "procedures_id", "batch_id", "code",
        "cpt_code", "units", "date_of_service_from", "date_of_entry",
    ).filter(window_pred)
    pvp = optional_in(pvp, "procedures_id", f.procedures)
    procs = dim(t, "procedures", ["procedures_id", "cpt_procedure_code_qualifier_mid"])
    pvp = lookup(pvp, procs, "procedures_id", "procedures_id", {"cpt_procedure_code_qualifier_mid": "_qual_mid"})
    return with_medlist(pvp, t, "_qual_mid", {"description": "qualifier"}).drop("_qual_mid")


def _service_window(f: LedgerFilter, mode: str):
    return in_window("date_of_service_from", f.start, f.end, mode)


def charge_amounts(t: Tables, f: LedgerFilter) -> DataFrame:
    """Line-level ledger amounts of charges: one row per procedure line in
    the window with a batch and an aggregate row.

    Window: the date type's column with the raw (exclusive) end, and the
    service date with end + 1 day; for 'DOS' the tighter raw end wins.
    """
    col = date_type_column(f.date_type, "date_of_service_from", "date_of_entry")
    selected = in_window(col, f.start, f.end, "end_exclusive") if col else F.lit(False)
    lines = procedure_lines(t, selected & _service_window(f, "end_plus_day"), f)
    lines = optional_in(lines, "batch_id", f.batches)
    lines = require_exists(lines, dim(t, "batch", ["batch_id"]), "batch_id")
    pvpa = within_key_range(
        t.patient_visit_procs_agg.select("patient_visit_procs_id", "orig_ins_allocation", "orig_pat_allocation"),
        lines, "patient_visit_procs_id",
    )
    rows = lines.join(pvpa, "patient_visit_procs_id")
    zero = F.lit(0).cast(LEDGER_MONEY)
    return rows.select(
        "patient_visit_id",
        "date_of_service_from",
        F.coalesce(F.col("code"), F.lit(NO_CODE_LABEL)).alias("cpt_code"),
        F.coalesce(F.col("qualifier"), F.lit(NONE_LABEL)).alias("hcpc"),
        flat_rate_ins_allocation("cpt_code", "orig_ins_allocation").cast(LEDGER_MONEY).alias("ins_allocation"),
        F.col("orig_pat_allocation").cast(LEDGER_MONEY).alias("pat_allocation"),
        F.col("orig_pat_allocation").cast(LEDGER_MONEY).alias("pat_balance"),
        F.col("orig_ins_allocation").cast(LEDGER_MONEY).alias("ins_balance"),
        zero.alias("ins_payment"),
        zero.alias("pat_payment"),
        flat_rate_ins_adjustment("cpt_code", "orig_ins_allocation").cast(LEDGER_MONEY).alias("ins_adjustment"),
        zero.alias("pat_adjustment"),
        line_encounter("qualifier", "units", "code").alias("line_encounter"),
    )


def route_payments(source: str = "source", action: str = "action", amount: str = "amount") -> dict:
    """Ledger columns of a payment distribution by payer source and action:
    balances fall by payments and adjustments; payments and adjustments are
    booked per payer. Other actions and sources book 0."""
    src, act, amt = F.col(source), F.col(action), F.col(amount)
    zero = F.lit(0)

    def on(cond, value):
        return F.when(cond, value).otherwise(zero)

    paid, adjusted = text_equals(act, ACTION_PAYMENT), text_equals(act, ACTION_ADJUSTMENT)
    return {
        "pat_balance": on((src == SOURCE_PATIENT) & (adjusted | paid), -amt),
        "ins_balance": on((src == SOURCE_INSURANCE) & (adjusted | paid), -amt),
        "ins_payment": on((src == SOURCE_INSURANCE) & paid, amt),
        "pat_payment": on((src == SOURCE_PATIENT) & paid, amt),
        "ins_adjustment": on((src == SOURCE_INSURANCE) & adjusted, amt),
        "pat_adjustment": on((src == SOURCE_PATIENT) & adjusted, amt),
    }


def payment_amounts(t: Tables, f: LedgerFilter) -> DataFrame:
    """Line-level ledger amounts of payments: one row per non-zero
    distribution on a procedure line served in the window (raw end); a 'DOE'
    run also needs the payment entered in the window. The visit is the visit
    transaction's visit.

    Joins start from the filtered procedure lines, the most selective side,
    and walk the payment chain distribution -> transaction -> visit
    transaction -> payment method.
    """
    lines = procedure_lines(t, _service_window(f, "end_exclusive"), f).select(
        "patient_visit_procs_id", "code", "qualifier", "date_of_service_from"
    )

    def moved(td: DataFrame) -> DataFrame:
        td = td.select("transactions_id", "patient_visit_procs_id", "amount").filter(F.col("amount") != 0)
        return within_key_range(td, lines, "patient_visit_procs_id")

    tr = t.transactions.select("transactions_id", "visit_transactions_id", "action")
    vt = t.visit_transactions.select("visit_transactions_id", "patient_visit_id", "payment_method_id")
    pm = t.payment_method.select(
        "payment_method_id", F.col("batch_id").alias("pm_batch_id"), "source",
        F.col("date_of_entry").alias("pm_date_of_entry"),
    )
    if f.date_type == "DOS":
        pm_window = F.lit(True)
    elif f.date_type == "DOE":
        pm_window = in_window("pm_date_of_entry", f.start, f.end, "end_exclusive")
    else:
        pm_window = F.lit(False)
    pm = optional_in(pm.filter(pm_window), "pm_batch_id", f.batches)
    pm = require_exists(pm, dim(t, "batch", ["batch_id"]), "pm_batch_id", "batch_id")
    rows = join_stored(t, "transaction_distributions", moved, lines)
    rows = join_split(t, join_split(t, rows, tr, TRANSACTION), vt, VISIT_TRANSACTION).join(pm, "payment_method_id")
    routed = route_payments()
    zero = F.lit(0).cast(LEDGER_MONEY)
    return rows.select(
        "patient_visit_id",
        "date_of_service_from",
        F.coalesce(F.col("code"), F.lit(NO_CODE_LABEL)).alias("cpt_code"),
        F.coalesce(F.col("qualifier"), F.lit(NONE_LABEL)).alias("hcpc"),
        zero.alias("ins_allocation"),
        zero.alias("pat_allocation"),
        *[routed[c].cast(LEDGER_MONEY).alias(c) for c in
          ("pat_balance", "ins_balance", "ins_payment", "pat_payment", "ins_adjustment", "pat_adjustment")],
        F.lit(0).alias("line_encounter"),
    )


def place_flags(line_flag: str = "line_encounter", pos: str = "pos_code") -> dict:
    """The four encounter flags from a (summed) line flag and the visit's
    place of service. Place 50 counts as office and other, 12 as other and
    home, a missing place as other."""
    p = F.col(pos)
    return {
        "ov_encounter": place_flag(place_in(p, OFFICE_POS), line_flag),
        "inpatient_encounter": place_flag(place_in(p, INPATIENT_POS), line_flag),
        "other_encounter": place_flag(place_not_in(p, NOT_OTHER_POS), line_flag),
        "home_encounter": place_flag(place_in(p, HOME_POS), line_flag),
    }


def stage_amounts(amounts: DataFrame, t: Tables, f: LedgerFilter) -> DataFrame:
    """Staged ledger rows from line amounts: visit attributes, month and the
    four encounter flags attached, cast to the ledger schema."""
    rows = with_visit_attributes(amounts, t, f)
    flags = place_flags()
    return to_ledger(
        rows.withColumns({"month_of_service": month_of("date_of_service_from"), **flags})
    )


def charge_rows(t: Tables, f: LedgerFilter) -> DataFrame:
    """Staged charge rows: one ledger row per procedure line in the window."""
    return stage_amounts(charge_amounts(t, f), t, f)


def payment_rows(t: Tables, f: LedgerFilter) -> DataFrame:
    """Staged payment rows: one ledger row per non-zero distribution."""
    return stage_amounts(payment_amounts(t, f), t, f)


AMOUNT_KEYS = ["patient_visit_id", "date_of_service_from", "cpt_code", "hcpc"]


def preaggregate_amounts(amounts: DataFrame) -> DataFrame:
    """Sum line-level amounts per visit, service time, code and qualifier
    (partial aggregation map-side, then one shuffle on these keys)."""
    return amounts.groupBy(*AMOUNT_KEYS).agg(
        *[F.sum(c).alias(c) for c in LEDGER_MONEY_COLUMNS],
        F.sum("line_encounter").cast("bigint").alias("line_encounter"),
    )


def preaggregate_ledger(ledger: DataFrame) -> DataFrame:
    """Partial sums of staged ledger rows per visit and ledger key."""
    return ledger.groupBy("patient_visit_id", *LEDGER_KEYS).agg(
        *[F.sum(c).alias(c) for c in LEDGER_MONEY_COLUMNS],
        *[F.sum(c).cast("bigint").alias(c) for c in ENCOUNTER_COLUMNS],
    )


REPORT_COLUMNS = [
    "ticket_number", "patient_id", "date_of_service", "month_of_service", "insurance_carrier",
    "policy_type", "doctor_name", "resource", "resource_type", "facility_name", "cpt_code",
    "charges", "pat_balance", "ins_balance", "ins_payment", "pat_payment", "ins_adjustment",
    "pat_adjustment", "ov_encounter", "inpatient_encounter", "other_encounter", "home_encounter",
    "hcpc", "count_enc", "data_source",
]
ROLLUP_KEYS = [*LEDGER_KEYS, "resource_label", "resource_type", "resource_id"]


def resource_context(t: Tables, resources: Sequence[int] | None = None,
                     within: DataFrame | None = None) -> DataFrame:
    """``(patient_visit_id, resource_id, resource_type, resource_label)``:
    the rollup's fan-out (one row per visit resource x provider type,
    duplicates kept) with the visit's resource label; ``within`` restricts
    it to those visits (the rest of the visit history is never aggregated)."""
    fan = optional_in(visit_resource_types(t, within=within), "resource_id", resources)
    return join_split(t, fan, resource_label_by_visit(t, within=within), VISIT, how="left")


def _final_rollup(expanded: DataFrame) -> DataFrame:
    """Group by the report keys, clamp the encounter sums, add count_enc.
    Grouping is on the full service timestamp although only its date is
    shown. Keeps the group keys that are not output columns
    (``company_name``, ``date_of_service_from``, ``resource_id``) for the
    report order."""
    summed = expanded.groupBy(*ROLLUP_KEYS).agg(
        *[F.sum(c).alias(c) for c in LEDGER_MONEY_COLUMNS],
        *[F.sum(c).alias(c) for c in ENCOUNTER_COLUMNS],
    )
    clamps = {c: clamp_unit(F.col(c)).cast("bigint") for c in ENCOUNTER_COLUMNS}
    count_enc = clamps["ov_encounter"] + clamps["inpatient_encounter"] + clamps["other_encounter"] + clamps["home_encounter"]
    return summed.select(
        "ticket_number",
        "patient_id",
        F.to_date("date_of_service_from").alias("date_of_service"),
        "month_of_service",
        "insurance_carrier",
        "policy_type",
        "doctor_name",
        F.coalesce(F.col("resource_label"), F.lit(NONE_LABEL)).alias("resource"),
        F.coalesce(F.col("resource_type"), F.lit(NONE_LABEL)).alias("resource_type"),
        "facility_name",
        "cpt_code",
        money(F.col("ins_allocation") + F.col("pat_allocation")).alias("charges"),
        *[money(c).alias(c) for c in
          ("pat_balance", "ins_balance", "ins_payment", "pat_payment", "ins_adjustment", "pat_adjustment")],
        *[clamps[c].alias(c) for c in ENCOUNTER_COLUMNS],
        "hcpc",
        count_enc.alias("count_enc"),
        F.lit(DATA_SOURCE).alias("data_source"),
        "company_name",
        "date_of_service_from",
        "resource_id",
    )


def rollup_ledger(ledger: DataFrame, t: Tables, resources: Sequence[int] | None = None) -> DataFrame:
    """Roll up a staged ledger per ticket, resource, type and procedure code.

    Each ledger row counts once per (visit resource x provider type) of its
    visit - the grouping keeps resource id and type apart, so report-wide
    totals overcount on purpose. Encounter sums are clamped into [-1, 1]
    (values -1, 0 and NULL pass) and added up as ``count_enc``. The ledger is
    pre-aggregated per visit before the fan-out join.
    """
    pre = preaggregate_ledger(ledger)
    return _final_rollup(join_split(t, pre, resource_context(t, resources), VISIT))


def encounter_rollup(
    t: Tables,
    f: LedgerFilter,
    excluded_tickets: Sequence[str] | DataFrame = (),
    resources: Sequence[int] | None = None,
) -> DataFrame:
    """The encounter rollup by eager aggregation (see the module docstring):
    the same result as ``rollup_ledger(build_ledger(charge_rows, payment_rows))``
    with the ticket exclusion applied."""
    amounts = charge_amounts(t, f).unionByName(payment_amounts(t, f))
    pre = join_visits(preaggregate_amounts(amounts), t, f)
    if excluded_tickets is not None and (isinstance(excluded_tickets, DataFrame) or len(excluded_tickets)):
        pre = exclude_keys(pre, "ticket_number", excluded_tickets)
    # The fan-out and labels are joined while the rows are still partitioned
    # by visit (they sit on the visit bucketing: no shuffle), before the
    # profile join. They are not restricted to the window's visits: payment
    # rows carry the visit transaction's visit, so the only exact
    # restriction would be the aggregated rows themselves, whose second use
    # Spark prunes differently (no exchange reuse: the payment chain would
    # run twice).
    expanded = join_profiles_and_dims(join_split(t, pre, resource_context(t, resources), VISIT), t, f)
    expanded = expanded.withColumns({"month_of_service": month_of("date_of_service_from"), **place_flags()})
    return _final_rollup(expanded)
