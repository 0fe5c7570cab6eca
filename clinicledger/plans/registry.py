"""Registered queries over the test data: one per operator group.

Each entry takes ``(spark, sf_dir)``, maps the driver's test tables to the
billing tables (``sources.fixture``) and returns a lazy DataFrame. The
parameters are the fixture's: the report windows are the reports' shapes
moved 20 years back, to where the test data lives.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import functools
import os
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinicledger.constants import (
    EXCLUDED_TICKETS,
    HOME_POS,
    INPATIENT_POS,
    NONE_LABEL,
    NOT_OTHER_POS,
    OFFICE_POS,
    TEST_PATIENT_MARKERS,
    UNKNOWN_LABEL,
)
from clinicledger.functions.classify import RateSchedule, effective_rate
from clinicledger.functions.dates import month_of, rolling_months
from clinicledger.functions.money import (
    charge_columns,
    encounter_flag,
    flat_rate_ins_allocation,
    line_encounter,
    money,
    place_in,
    place_not_in,
)
from clinicledger.operators import collections as coll
from clinicledger.operators import closing, dims, filters, ledger, resources
from clinicledger.plans import reports
from clinicledger.plans.params import EncounterParams, RevenueParams
from clinicledger.sources.fixture import fixture_tables
from clinicledger.session import ensure_checkpoint_dir, join_in_place
from clinicledger.sources.sinks import SORT_PREFIX, read_report, report_positions, write_report
from clinicledger.sources.store import materialize_enabled, stored_copy
from clinicledger.sources.tables import Tables

# --- fixture parameters (FIXTURES.md section 4) ------------------------------
AS_OF = dt.datetime(1998, 1, 15)
ENCOUNTER = EncounterParams(start=dt.datetime(1997, 1, 1), end=dt.datetime(1997, 3, 31, 23, 59, 59, 997000))
ENCOUNTER_DOE = EncounterParams(
    start=ENCOUNTER.start, end=ENCOUNTER.end, date_type="DOE"
)
REVENUE = RevenueParams.rolling(
    AS_OF,
    closing=dt.datetime(1997, 6, 30, 12, 0),
    cutoff=dt.date(1997, 12, 31),
    rates=RateSchedule().shifted(-20),
)
REVENUE_DOE = dataclasses.replace(REVENUE, date_type="DOE")
# variants with every optional list set (values chosen to cut each dimension)
ENCOUNTER_FILTERED = dataclasses.replace(
    ENCOUNTER,
    doctors=(0, 2, 3, 5, 7, 9),
    facilities=tuple(1000000 + k for k in range(0, 25, 2)),
    companies=(2000000, 2000001, 2000003, 2000004),
    carriers=tuple(range(1, 25, 3)),
    batches=tuple(range(5, 45)),
    resources=(0, 1, 2, 4, 6, 7, 9),
)
REVENUE_FILTERED = dataclasses.replace(
    REVENUE, facilities=tuple(1000000 + k for k in (1, 4, 9, 16, 21)), carriers=tuple(range(0, 25, 2))
)
INCENTIVE_PATIENT = "48"
OPTIONAL_DOCTORS = (1, 3, 5)
OPTIONAL_FACILITIES = (1000002, 1000007, 1000011, 1000019)

# closes of the moving-close queries: closing instant and cut-off date
CLOSES = {
    "1997-06-30": (REVENUE.closing, REVENUE.cutoff),
    "1997-09-14": (dt.datetime(1997, 9, 14, 8, 15), dt.date(1997, 9, 20)),
    "1997-12-31": (dt.datetime(1997, 12, 31), dt.date(1997, 11, 30)),  # cut-off before the close
}

_TABLES: dict[tuple[str, str], Tables] = {}
_CLOSE_SUMS: dict[tuple[str, str], closing.CloseSums] = {}
_TABLES_LOCK = threading.Lock()


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Billing tables mapped from the test data under ``sf_dir``.

    Each table is derived once per session, when it is first used, and stored
    as Parquet under ``spark.checkpoint.dir`` (set ``CLINICLEDGER_MATERIALIZE=0`` to run every
    query on the lazy mapping instead); the reports then read stored tables,
    as they do in production.
    """
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    join_in_place(spark)
    with _TABLES_LOCK:  # queries run from several threads share one copy
        return _tables_locked(spark, sf_dir, key)


def _tables_locked(spark: SparkSession, sf_dir: str, key: tuple[str, str]) -> Tables:
    if key not in _TABLES:
        mapped = fixture_tables(spark, sf_dir)
        tables_ = mapped
        if materialize_enabled():
            tables_ = stored_copy(spark, mapped, key[1])
        _TABLES[key] = tables_
    return _TABLES[key]


# --- reports -----------------------------------------------------------------

def q_visit_payments(spark, sf_dir):
    return reports.visit_payments(tables(spark, sf_dir), INCENTIVE_PATIENT)


def q_encounter_report(spark, sf_dir):
    return reports.encounter_report(tables(spark, sf_dir), ENCOUNTER)


def q_encounter_report_doe(spark, sf_dir):
    return reports.encounter_report(tables(spark, sf_dir), ENCOUNTER_DOE)


def q_revenue_journal(spark, sf_dir):
    return reports.revenue_journal(tables(spark, sf_dir), REVENUE)


def q_revenue_journal_doe(spark, sf_dir):
    return reports.revenue_journal(tables(spark, sf_dir), REVENUE_DOE)


def q_revenue_journal_no_start(spark, sf_dir):
    return reports.revenue_journal(tables(spark, sf_dir), dataclasses.replace(REVENUE, start=None))


def q_revenue_journal_no_end(spark, sf_dir):
    return reports.revenue_journal(tables(spark, sf_dir), dataclasses.replace(REVENUE, end=None))


def q_written_encounter_report(spark, sf_dir):
    """The encounter report written by the sink and read back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/written-report-{uuid.uuid4().hex}"
    report = reports.encounter_report(tables(spark, sf_dir), ENCOUNTER, sort_keys=True)
    write_report(report, path)
    return read_report(spark, path).select(*reports.REPORT_COLUMNS)


def _written_order(spark, report: DataFrame, keys: tuple[str, ...], shown: tuple[str, ...]) -> DataFrame:
    """Position of each row of a written report in its month, with its sort keys."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/written-report-{uuid.uuid4().hex}"
    write_report(report, path, keep_sort_keys=True)
    columns = [f"{SORT_PREFIX}{k}_{c}" for k, c in enumerate(keys)]
    placed = report_positions(spark, path, columns)
    return placed.select(
        "month_of_service", "position", "ascends", *[F.col(c).alias(k) for c, k in zip(columns, keys) if k in shown]
    )


def q_encounter_report_order(spark, sf_dir):
    """The encounter report's rows where its sink put them (O2)."""
    report = reports.encounter_report(tables(spark, sf_dir), ENCOUNTER, sort_keys=True)
    keys = ("company_name", "facility_name", "ticket_number", *reports.ORDER_TIE_BREAK)
    shown = ("company_name", "facility_name", "ticket_number", "date_of_service_from", "cpt_code", "resource_id")
    return _written_order(spark, report, keys, shown)


def q_revenue_journal_order(spark, sf_dir):
    """The revenue journal's rows where its sink put them (O1)."""
    report = reports.revenue_journal(tables(spark, sf_dir), REVENUE, sort_keys=True)
    keys = ("date_of_service_from", "patient_visit_id", "patient_visit_procs_id")
    return _written_order(spark, report, keys, keys)


def q_encounter_report_no_resource(spark, sf_dir):
    """Any other value of the resource switch gives no rows (F14)."""
    return reports.encounter_report(tables(spark, sf_dir), dataclasses.replace(ENCOUNTER, include_resource=2))


def q_revenue_journal_filtered(spark, sf_dir):
    return reports.revenue_journal(tables(spark, sf_dir), REVENUE_FILTERED)


def q_encounter_report_filtered(spark, sf_dir):
    return reports.encounter_report(tables(spark, sf_dir), ENCOUNTER_FILTERED)


# --- filters -----------------------------------------------------------------

def _lines(t: Tables) -> DataFrame:
    return t.patient_visit_procs.select(
        "patient_visit_procs_id", "patient_visit_id", "date_of_service_from", "date_of_entry"
    )


def q_rolling_window_lines(spark, sf_dir):
    start, end = rolling_months(AS_OF, 12)
    df = filters.date_window(_lines(tables(spark, sf_dir)), "date_of_service_from", start, end, "end_plus_day")
    return df.select("patient_visit_procs_id", "date_of_service_from",
                     month_of("date_of_service_from").alias("month_of_service"))


def _encounter_window(t: Tables, p: EncounterParams) -> DataFrame:
    col = filters.date_type_column(p.date_type, "date_of_service_from", "date_of_entry")
    df = filters.date_window(_lines(t), col, p.start, p.end, "end_exclusive")
    return filters.date_window(df, "date_of_service_from", p.start, p.end, "end_plus_day")


def q_date_window_dos(spark, sf_dir):
    return _encounter_window(tables(spark, sf_dir), ENCOUNTER)


def q_date_window_doe(spark, sf_dir):
    return _encounter_window(tables(spark, sf_dir), ENCOUNTER_DOE)


def q_date_window_between(spark, sf_dir):
    return filters.date_window(_lines(tables(spark, sf_dir)), "date_of_service_from",
                               REVENUE.start, REVENUE.end, "between")


def q_date_window_open(spark, sf_dir):
    """Unset start (open) and an end: everything served through 1995-06-30."""
    return filters.date_window(_lines(tables(spark, sf_dir)), "date_of_service_from",
                               None, dt.datetime(1995, 6, 30), "end_plus_day")


def _visits(t: Tables) -> DataFrame:
    return t.patient_visit.select("patient_visit_id", "doctor_id", "facility_id", "ticket_number")


def q_optional_in_set(spark, sf_dir):
    df = filters.optional_in(_visits(tables(spark, sf_dir)), "doctor_id", OPTIONAL_DOCTORS)
    return filters.optional_in(df, "facility_id", OPTIONAL_FACILITIES)


def q_optional_in_unset(spark, sf_dir):
    df = filters.optional_in(_visits(tables(spark, sf_dir)), "doctor_id", None)
    return filters.optional_in(df, "facility_id", None)


def q_exclude_tickets(spark, sf_dir):
    return filters.exclude_keys(_visits(tables(spark, sf_dir)), "ticket_number", EXCLUDED_TICKETS)


def _respelled(col: str, key: str) -> F.Column:
    """``col`` in lower case, with trailing blanks, or both, by ``key``."""
    text, kind = F.col(col), F.col(key) % 3
    return F.when(kind == 0, F.concat(F.lower(text), F.lit("  "))).when(kind == 1, F.concat(text, F.lit(" "))).otherwise(F.lower(text))


def q_exclude_tickets_respelled(spark, sf_dir):
    """The ticket list against tickets in other spellings."""
    df = _visits(tables(spark, sf_dir)).withColumn("ticket_number", _respelled("ticket_number", "patient_visit_id"))
    return filters.exclude_keys(df, "ticket_number", EXCLUDED_TICKETS).select(
        "patient_visit_id", F.trim("ticket_number").alias("ticket")
    )


def q_line_codes_respelled(spark, sf_dir):
    """The flat-rate and no-encounter code lists against codes in other spellings."""
    lines = tables(spark, sf_dir).patient_visit_procs.select("patient_visit_procs_id", *[
        _respelled(c, "patient_visit_procs_id").alias(c) for c in ("code", "cpt_code")
    ], F.lit("hcpc - med").alias("qualifier"), F.lit(1).alias("units"))
    return lines.select(
        "patient_visit_procs_id",
        flat_rate_ins_allocation("cpt_code", F.lit(1)).cast("int").alias("allocated"),
        line_encounter("qualifier", "units", "code").cast("int").alias("encounter"),
    )


def q_exclude_void_visits(spark, sf_dir):
    """Visits without the void marker in a description (Q2); a missing one drops."""
    key, ticket = F.col("patient_visit_id"), F.col("ticket_number")
    description = F.when(key % 7 == 0, F.concat(F.lit("Moved *VOID* "), ticket)).when(
        key % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Visit "), ticket))
    df = _visits(tables(spark, sf_dir)).withColumn("description", description)
    return filters.exclude_void_visits(df, "description").select("patient_visit_id", "description")


def q_exclude_test_patients(spark, sf_dir):
    t = tables(spark, sf_dir)
    return filters.exclude_test_patients(t.patient_profile, "last", TEST_PATIENT_MARKERS, ignore_case=True)


def q_batch_exists(spark, sf_dir):
    t = tables(spark, sf_dir)
    lines = t.patient_visit_procs.select("patient_visit_procs_id", "batch_id")
    return dims.require_exists(lines, dims.dim(t, "batch", ["batch_id"]), "batch_id")


def q_collected_as_of(spark, sf_dir):
    t = tables(spark, sf_dir)
    pm = t.payment_method.select("payment_method_id", "source", "check_date", "date_of_entry")
    return filters.collected_as_of(pm, "date_of_entry", "check_date", REVENUE.closing, REVENUE.cutoff)


def q_nonzero_distributions(spark, sf_dir):
    t = tables(spark, sf_dir)
    return filters.nonzero(coll.payment_lines(t, visits=True), "amount").select(
        "transactions_id", "patient_visit_procs_id", "patient_visit_id", "amount", "action", "source"
    )


# --- dimensions and resources ------------------------------------------------

def q_provider_roles(spark, sf_dir):
    t = tables(spark, sf_dir)
    v = t.patient_visit.select("patient_visit_id", "doctor_id", "facility_id", "company_id")
    v = dims.with_providers(v, t, {"doctor_id": "doctor_name", "facility_id": "facility_name",
                                   "company_id": "company_name"})
    return v.select("patient_visit_id", "doctor_name", "facility_name", "company_name")


def q_medlist_roles(spark, sf_dir):
    """Procedure lines with department and qualifier, their visit's policy
    type and place of service; unmatched lookups get the reports' defaults."""
    t = tables(spark, sf_dir)
    pvp = t.patient_visit_procs.select("patient_visit_procs_id", "patient_visit_id", "procedures_id")
    procs = dims.dim(t, "procedures", ["procedures_id", "department_mid", "cpt_procedure_code_qualifier_mid"])
    df = dims.lookup(pvp, procs, "procedures_id", "procedures_id",
                     {"department_mid": "department_mid", "cpt_procedure_code_qualifier_mid": "qual_mid"})
    df = dims.with_medlist(df, t, "department_mid", {"description": "department"})
    df = dims.with_medlist(df, t, "qual_mid", {"description": "hcpc"})
    pv = t.patient_visit.select("patient_visit_id", "facility_id", "primary_insurance_carriers_id")
    carriers = dims.dim(t, "insurance_carriers", ["insurance_carriers_id", "policy_type_mid"])
    pv = dims.lookup(pv, carriers, "primary_insurance_carriers_id", "insurance_carriers_id",
                     {"policy_type_mid": "policy_type_mid"})
    pv = dims.with_medlist(pv, t, "policy_type_mid", {"description": "policy_type"})
    pv = dims.facility_place(pv, t, "facility_id", "pos")
    df = df.join(pv, "patient_visit_id")
    df = df.withColumns({"department_mid": F.coalesce("department_mid", F.lit(0).cast("bigint")),
                         "policy_type_mid": F.coalesce("policy_type_mid", F.lit(0).cast("bigint"))})
    df = dims.with_defaults(df, {"department": UNKNOWN_LABEL, "hcpc": NONE_LABEL,
                                 "policy_type": UNKNOWN_LABEL, "pos": NONE_LABEL})
    return df.select("patient_visit_procs_id", "department_mid", "department", "hcpc",
                     "policy_type_mid", "policy_type", "pos")


def q_resource_label_by_visit(spark, sf_dir):
    return resources.resource_label_by_visit(tables(spark, sf_dir))


def q_resource_label_by_assignment(spark, sf_dir):
    return resources.resource_label_by_assignment(tables(spark, sf_dir))


def q_expand_resources(spark, sf_dir):
    return resources.visit_resource_types(tables(spark, sf_dir))


def q_resource_fanout(spark, sf_dir):
    return resources.resource_fanout(tables(spark, sf_dir))


def q_effective_rate(spark, sf_dir):
    t = tables(spark, sf_dir)
    return t.patient_visit_procs.select(
        "patient_visit_procs_id", "date_of_service_from",
        effective_rate("date_of_service_from", REVENUE.rates).alias("pps_rate"),
    )


def q_effective_rate_table(spark, sf_dir):
    """The same rates from a rate table (range join) instead of the ladder."""
    from clinicledger.operators.rates import effective_rate_from_table, schedule_table

    t = tables(spark, sf_dir)
    lines = t.patient_visit_procs.select("patient_visit_procs_id", "date_of_service_from")
    return effective_rate_from_table(lines, schedule_table(spark, REVENUE.rates), "date_of_service_from", "pps_rate")


# --- encounter ledger ---------------------------------------------------------

def q_charge_rows(spark, sf_dir):
    return ledger.charge_rows(tables(spark, sf_dir), ENCOUNTER.ledger_filter())


def q_payment_rows(spark, sf_dir):
    return ledger.payment_rows(tables(spark, sf_dir), ENCOUNTER.ledger_filter())


def q_encounter_flags(spark, sf_dir):
    """Encounter flags of every procedure line (whole table)."""
    t = tables(spark, sf_dir)
    pvp = t.patient_visit_procs.select("patient_visit_procs_id", "patient_visit_id", "procedures_id", "code", "units")
    procs = dims.dim(t, "procedures", ["procedures_id", "cpt_procedure_code_qualifier_mid"])
    df = dims.lookup(pvp, procs, "procedures_id", "procedures_id", {"cpt_procedure_code_qualifier_mid": "qual_mid"})
    df = dims.with_medlist(df, t, "qual_mid", {"description": "qualifier"})
    pv = dims.facility_place(t.patient_visit.select("patient_visit_id", "facility_id"), t, "facility_id", "pos")
    df = df.join(pv, "patient_visit_id")
    pos, q, u, c = F.col("pos"), F.col("qualifier"), F.col("units"), F.col("code")
    return df.select(
        "patient_visit_procs_id",
        encounter_flag(place_in(pos, OFFICE_POS), q, u, c).alias("ov_encounter"),
        encounter_flag(place_in(pos, INPATIENT_POS), q, u, c).alias("inpatient_encounter"),
        encounter_flag(place_not_in(pos, NOT_OTHER_POS), q, u, c).alias("other_encounter"),
        encounter_flag(place_in(pos, HOME_POS), q, u, c).alias("home_encounter"),
    )


def q_ledger_union(spark, sf_dir):
    return reports.encounter_ledger(tables(spark, sf_dir), ENCOUNTER)


def q_ledger_rollup(spark, sf_dir):
    """The rollup over the whole ledger (no ticket exclusion, no order)."""
    t = tables(spark, sf_dir)
    return ledger.rollup_ledger(reports.encounter_ledger(t, ENCOUNTER), t).select(*ledger.REPORT_COLUMNS)


# --- revenue journal parts ---------------------------------------------------

def q_payment_pivot(spark, sf_dir):
    """Payments per procedure line x check x payer x source x entry date for
    lines in the revenue window, collected as of the close."""
    t = tables(spark, sf_dir)
    spine = coll.visit_lines(t, REVENUE.date_type, REVENUE.start, REVENUE.end)
    paid = coll.payment_lines(t, spine).filter(
        filters.collected_as_of_predicate("pm_date_of_entry", "check_date", REVENUE.closing, REVENUE.cutoff)
    )
    keys = ("patient_visit_procs_id", "check_card_number", "check_date", "payer_type", "source", "pm_date_of_entry")
    out = coll.pivot_payments(paid, t, keys)
    return out.select(*keys, *[money(c).alias(c) for c in coll.PIVOT_COLUMNS])


def q_collections(spark, sf_dir):
    p = REVENUE
    return coll.collections(tables(spark, sf_dir), p.date_type, p.start, p.end, p.closing, p.cutoff)


def close_sums(spark: SparkSession, sf_dir: str) -> closing.CloseSums:
    """The stored sums of all payments, written once per session."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    t = tables(spark, sf_dir)
    with _TABLES_LOCK:
        if key not in _CLOSE_SUMS:
            path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/close-sums-{uuid.uuid4().hex}"
            _CLOSE_SUMS[key] = closing.write_close_sums(t, path)
        return _CLOSE_SUMS[key]


def q_collections_moving_close(spark, sf_dir):
    """Collections of the window's lines at three accounting closes, from one
    store of sums."""
    t, sums, p = tables(spark, sf_dir), close_sums(spark, sf_dir), REVENUE
    parts = []
    for day, (close, cutoff) in CLOSES.items():
        totals = functools.partial(closing.closed_totals, sums, closing=close, cutoff=cutoff)
        rows = coll.collections(t, p.date_type, p.start, p.end, close, cutoff, totals_of=totals)
        parts.append(rows.withColumn("closed", F.lit(day)))
    return functools.reduce(DataFrame.unionByName, parts)


def q_revenue_journal_stored_sums(spark, sf_dir):
    """The revenue journal at another close, from the stored sums."""
    close, cutoff = CLOSES["1997-09-14"]
    p = dataclasses.replace(REVENUE, closing=close, cutoff=cutoff)
    return reports.revenue_journal(tables(spark, sf_dir), p, sums=close_sums(spark, sf_dir))


def q_charge_math(spark, sf_dir):
    t = tables(spark, sf_dir)
    df = reports.revenue_lines(t, REVENUE).join(reports.revenue_visits(t, REVENUE, with_resources=False),
                                                "patient_visit_id")
    amounts = charge_columns()
    return df.select(
        "patient_visit_procs_id",
        F.to_date("date_of_service_from").alias("date_of_service"),
        month_of("date_of_service_from").alias("month_of_service"),
        *[amounts[c].alias(c) for c in ("charges", "adjustments", "net_charges")],
    )


def q_adjustment_check(spark, sf_dir):
    """Lines whose booked adjustments differ from those collected."""
    rj = reports.revenue_journal(tables(spark, sf_dir), dataclasses.replace(REVENUE, ordered=False))
    return filters.adjustment_mismatches(rj).select(
        "ticket_number", "date_of_service", "cpt_code", "adjustments", "sum_adj_to_date",
        "adjustments_diff", "abs_adjustments_diff",
    )


def q_payer_and_service_class(spark, sf_dir):
    rj = reports.revenue_journal(tables(spark, sf_dir), dataclasses.replace(REVENUE, ordered=False))
    return rj.select(
        "ticket_number", "date_of_service", "cpt_code", "resource", "resource_type", "service_type",
        "policy_type", "primary_insurance_carrier", "broad_payer_type",
    )


def comparable(df: DataFrame) -> DataFrame:
    """Engine-neutral presentation of a result for the oracle comparison:
    decimals as double (exact here: both engines cast the same decimal
    value), dates as ``yyyy-MM-dd`` and timestamps as
    ``yyyy-MM-dd HH:mm:ss.SSSSSS`` text. Engines hand these types to Python
    and pandas differently (Decimal vs float, date vs datetime, ns vs us);
    strings, integers and doubles compare the same under any conversion.
    The library's own results keep ``decimal(18,2)``, ``date`` and
    ``timestamp_ntz``."""
    from pyspark.sql.types import DateType, DecimalType, TimestampNTZType, TimestampType

    cols = []
    for field in df.schema.fields:
        if isinstance(field.dataType, DecimalType):
            cols.append(F.col(field.name).cast("double").alias(field.name))
        elif isinstance(field.dataType, DateType):
            cols.append(F.date_format(field.name, "yyyy-MM-dd").alias(field.name))
        elif isinstance(field.dataType, (TimestampNTZType, TimestampType)):
            cols.append(F.date_format(field.name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(field.name))
        else:
            cols.append(F.col(field.name))
    return df.select(cols)


def _presented(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(query(spark, sf_dir))

    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    return run


RAW_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "visit_payments": q_visit_payments,
    "rolling_window_lines": q_rolling_window_lines,
    "date_window_dos": q_date_window_dos,
    "date_window_doe": q_date_window_doe,
    "date_window_between": q_date_window_between,
    "date_window_open": q_date_window_open,
    "optional_in_set": q_optional_in_set,
    "optional_in_unset": q_optional_in_unset,
    "exclude_tickets": q_exclude_tickets,
    "exclude_test_patients": q_exclude_test_patients,
    "batch_exists": q_batch_exists,
    "collected_as_of": q_collected_as_of,
    "nonzero_distributions": q_nonzero_distributions,
    "provider_roles": q_provider_roles,
    "medlist_roles": q_medlist_roles,
    "resource_label_by_visit": q_resource_label_by_visit,
    "resource_label_by_assignment": q_resource_label_by_assignment,
    "expand_resources": q_expand_resources,
    "resource_fanout": q_resource_fanout,
    "effective_rate": q_effective_rate,
    "effective_rate_table": q_effective_rate_table,
    "charge_rows": q_charge_rows,
    "payment_rows": q_payment_rows,
    "encounter_flags": q_encounter_flags,
    "ledger_union": q_ledger_union,
    "ledger_rollup": q_ledger_rollup,
    "encounter_report": q_encounter_report,
    "encounter_report_doe": q_encounter_report_doe,
    "payment_pivot": q_payment_pivot,
    "collections": q_collections,
    "collections_moving_close": q_collections_moving_close,
    "revenue_journal_stored_sums": q_revenue_journal_stored_sums,
    "charge_math": q_charge_math,
    "adjustment_check": q_adjustment_check,
    "payer_and_service_class": q_payer_and_service_class,
    "revenue_journal": q_revenue_journal,
    "revenue_journal_doe": q_revenue_journal_doe,
    "revenue_journal_filtered": q_revenue_journal_filtered,
    "revenue_journal_no_start": q_revenue_journal_no_start,
    "revenue_journal_no_end": q_revenue_journal_no_end,
    "written_encounter_report": q_written_encounter_report,
    "encounter_report_filtered": q_encounter_report_filtered,
    "encounter_report_no_resource": q_encounter_report_no_resource,
    "encounter_report_order": q_encounter_report_order,
    "revenue_journal_order": q_revenue_journal_order,
    "exclude_tickets_respelled": q_exclude_tickets_respelled,
    "line_codes_respelled": q_line_codes_respelled,
    "exclude_void_visits": q_exclude_void_visits,
}


# what the driver runs: the same queries, presented engine-neutrally
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: _presented(query) for name, query in RAW_QUERIES.items()
}
