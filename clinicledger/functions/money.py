"""Ledger arithmetic and encounter flags as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinicledger.constants import (
    ENCOUNTER_PREFIXES,
    FLAT_RATE_CPT_CODES,
    NON_ENCOUNTER_CODES,
    REVERSAL_PREFIXES,
)
from clinicledger.functions.text import prefix_in, text_in

# Row-level money (as stored) and report-level money (sums).
LEDGER_MONEY = "decimal(10,2)"
REPORT_MONEY = "decimal(18,2)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(col: Column | str) -> Column:
    """Report money type; sums of ``decimal(10,2)`` fit comfortably."""
    return _col(col).cast(REPORT_MONEY)


def ledger_money(col: Column | str) -> Column:
    """Round to cents per row, as the staged ledger stores amounts."""
    return _col(col).cast(LEDGER_MONEY)


def clamp_unit(col: Column | str) -> Column:
    """Clamp a summed flag: ``>= 1`` -> 1, ``< -1`` -> -1, else unchanged
    (so -1, 0 and NULL pass through). ``least/greatest`` would turn NULL
    into -1, hence the CASE form."""
    c = _col(col)
    return F.when(c >= 1, F.lit(1)).when(c < -1, F.lit(-1)).otherwise(c)


def flat_rate_ins_allocation(cpt_code: Column | str, orig_ins: Column | str,
                             codes: Sequence[str] = FLAT_RATE_CPT_CODES) -> Column:
    """Insurance allocation of a charge line: 0 for flat-rate visit codes."""
    return F.when(text_in(cpt_code, codes), F.lit(0)).otherwise(_col(orig_ins))


def flat_rate_ins_adjustment(cpt_code: Column | str, orig_ins: Column | str,
                             codes: Sequence[str] = FLAT_RATE_CPT_CODES) -> Column:
    """The reclassed insurance allocation, booked as a negative adjustment."""
    return F.when(text_in(cpt_code, codes), -_col(orig_ins)).otherwise(F.lit(0))


def line_encounter(
    qualifier: Column | str,
    units: Column | str,
    code: Column | str,
    excluded_codes: Sequence[str] = NON_ENCOUNTER_CODES,
    reversal_prefixes: Sequence[str] = REVERSAL_PREFIXES,
    encounter_prefixes: Sequence[str] = ENCOUNTER_PREFIXES,
) -> Column:
    """The line's part of an encounter flag, before the place test.

    -1 when the 8-character qualifier prefix is a reversal class and units
    are negative; else 1 when the 10-character prefix is an encounter class
    and the code is not excluded; else 0. A NULL code makes ``NOT IN``
    unknown, so the +1 arm fails; the -1 arm does not look at the code.
    """
    reversal = prefix_in(qualifier, 8, reversal_prefixes) & (_col(units) < 0)
    counted = prefix_in(qualifier, 10, encounter_prefixes) & ~text_in(code, excluded_codes)
    return F.when(reversal, F.lit(-1)).when(counted, F.lit(1)).otherwise(F.lit(0))


def place_flag(place_ok: Column, line_flag: Column | str) -> Column:
    """Encounter flag for one kind of place: the line flag where the place
    test is TRUE, else 0 (also for a NULL test).

    Because the place of service belongs to the visit, the same holds for
    sums: the sum of a visit's flags is ``place_flag(place_ok, sum of line
    flags)``, which lets line flags be summed before the visit is joined.
    """
    return F.when(place_ok, _col(line_flag)).otherwise(F.lit(0))


def encounter_flag(
    place_ok: Column,
    qualifier: Column | str,
    units: Column | str,
    code: Column | str,
    excluded_codes: Sequence[str] = NON_ENCOUNTER_CODES,
    reversal_prefixes: Sequence[str] = REVERSAL_PREFIXES,
    encounter_prefixes: Sequence[str] = ENCOUNTER_PREFIXES,
) -> Column:
    """Signed encounter flag of one charge line at a place (-1, 0 or 1)."""
    return place_flag(
        place_ok, line_encounter(qualifier, units, code, excluded_codes, reversal_prefixes, encounter_prefixes)
    )


def place_in(pos_code: Column | str, codes: Sequence[str]) -> Column:
    return text_in(pos_code, codes)


def place_not_in(pos_code: Column | str, codes: Sequence[str]) -> Column:
    """``ISNULL(code, '') NOT IN (...)``: a missing place counts as not in."""
    return ~text_in(F.coalesce(_col(pos_code), F.lit("")), codes)


def charge_columns(ins_allocation: str = "ins_allocation", pat_allocation: str = "pat_allocation",
                   ins_adjustment: str = "ins_adjustment", pat_adjustment: str = "pat_adjustment") -> dict:
    """Charges, adjustments and net charges of a procedure line."""
    ia, pa, ij, pj = (F.col(c) for c in (ins_allocation, pat_allocation, ins_adjustment, pat_adjustment))
    return {
        "charges": money(ia + pa),
        "adjustments": money(ij + pj),
        "net_charges": money((ia - ij) + (pa - pj)),
    }


def adjustment_check_columns(booked: Column, collectable: str = "collectable_adjustments",
                             non_collectable: str = "non_collectable_adjustments") -> dict:
    """Reconciliation of booked adjustments with those collected to date.

    The two components default to 0; their sum and the differences stay
    NULL when a line has no collections row.
    """
    ca, na = F.col(collectable), F.col(non_collectable)
    collected = ca + na
    return {
        "collectable_adjustments_to_date": money(F.coalesce(ca, F.lit(0))),
        "non_collectable_adjustments_to_date": money(F.coalesce(na, F.lit(0))),
        "sum_adj_to_date": money(collected),
        "adjustments_diff": money(booked - collected),
        "abs_adjustments_diff": money(F.abs(booked - collected)),
    }
