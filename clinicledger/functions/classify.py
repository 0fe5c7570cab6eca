"""Classification expressions of the revenue journal (payer, resource,
service line, collectability, effective rate)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinicledger.constants import (
    BROAD_PAYER_TYPES,
    COLLECTABLE_FLAG,
    NON_COLLECTABLE_FLAG,
    NONE_ERROR_LABEL,
    NONE_LABEL,
    OTHER_ERROR,
    OTHER_NON_BILLABLE,
    OTHER_PAYER_TYPE,
    PLB_PROVIDER,
    PLB_TYPE,
    PPS_RATE_DATES,
    PPS_RATES,
    SERVICE_TYPES,
)
from clinicledger.functions.text import text_equals
from clinicledger.functions.dates import ts_lit


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def broad_payer_type(
    policy_type_id: Column | str,
    mapping: Sequence[tuple[str, Sequence[int]]] = BROAD_PAYER_TYPES,
    default: str = OTHER_PAYER_TYPE,
) -> Column:
    """Payer class from the policy type id; first match wins, NULL and
    unmapped ids get ``default``."""
    c = _col(policy_type_id)
    out = None
    for label, ids in mapping:
        cond = c.isin(list(ids))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def _missing(label: Column | str) -> Column:
    """``ISNULL(label, 'None') = 'None'``: missing, or literally 'None'."""
    return F.coalesce(_col(label), F.lit(NONE_LABEL)) == NONE_LABEL


def resource_or_fallback(resource_name: Column | str, doctor_name: Column | str,
                         charges: Column | str) -> Column:
    """Resource label; without one: the PLB provider, 'None' for lines
    without charges, else 'None/Error'."""
    return (
        F.when(_missing(resource_name) & (_col(doctor_name) == PLB_PROVIDER), F.lit(PLB_PROVIDER))
        .when(_missing(resource_name) & (_col(charges) == 0), F.lit(NONE_LABEL))
        .otherwise(F.coalesce(_col(resource_name), F.lit(NONE_ERROR_LABEL)))
    )


def resource_type_or_fallback(resource_type: Column | str, doctor_name: Column | str,
                              charges: Column | str) -> Column:
    """Resource type; without one: 'PLB', 'Other/Non-Billable' for lines
    without charges, else 'None/Error'."""
    return (
        F.when(_missing(resource_type) & (_col(doctor_name) == PLB_PROVIDER), F.lit(PLB_TYPE))
        .when(_missing(resource_type) & (_col(charges) == 0), F.lit(OTHER_NON_BILLABLE))
        .otherwise(F.coalesce(_col(resource_type), F.lit(NONE_ERROR_LABEL)))
    )


def service_type(resource_type: Column | str, charges: Column | str) -> Column:
    """Service line from the resource type (BHC / Medical / Dental), lines
    without type and charges are 'Other/Non-Billable', the rest 'Other/Error'."""
    rt = F.coalesce(_col(resource_type), F.lit(NONE_LABEL))
    out = None
    for label, types in SERVICE_TYPES:
        cond = rt.isin(list(types))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.when((rt == NONE_LABEL) & (_col(charges) == 0), F.lit(OTHER_NON_BILLABLE)).otherwise(
        F.lit(OTHER_ERROR)
    )


def is_collectable(function_name: Column | str) -> Column:
    """Adjustment type flag 'Y' (in either case, trailing blanks aside) or missing."""
    return text_equals(F.coalesce(_col(function_name), F.lit(COLLECTABLE_FLAG)), COLLECTABLE_FLAG)


def is_non_collectable(function_name: Column | str) -> Column:
    """Adjustment type flag 'N' (other flags are neither)."""
    return text_equals(F.coalesce(_col(function_name), F.lit(COLLECTABLE_FLAG)), NON_COLLECTABLE_FLAG)


@dataclass(frozen=True)
class RateSchedule:
    """Effective-dated rates: ``rates[i]`` applies from ``dates[i-1]``
    (inclusive) to ``dates[i]`` (exclusive); ``rates[0]`` applies up to and
    including ``dates[0]``; from the last date on the rate is NULL."""

    dates: tuple[dt.datetime, ...] = PPS_RATE_DATES
    rates: tuple[Decimal | None, ...] = PPS_RATES

    def __post_init__(self):
        if len(self.dates) != len(self.rates):
            raise ValueError("one rate per effective date")
        if list(self.dates) != sorted(self.dates):
            raise ValueError("effective dates must ascend")

    def shifted(self, years: int) -> "RateSchedule":
        return RateSchedule(tuple(d.replace(year=d.year + years) for d in self.dates), self.rates)

    def intervals(self) -> list[tuple[dt.datetime | None, dt.datetime | None, Decimal | None]]:
        """``(from, to, rate)`` rows; ``from`` None = open start."""
        out = [(None, self.dates[0], self.rates[0])]
        for i in range(1, len(self.dates)):
            out.append((self.dates[i - 1], self.dates[i], self.rates[i]))
        out.append((self.dates[-1], None, None))
        return out


def effective_rate(date_col: Column | str, schedule: RateSchedule, rate_type: str = "decimal(10,2)") -> Column:
    """Rate in effect at ``date_col`` as a CASE ladder (first arm closed on
    the right, later arms half-open, NULL date -> NULL). A schedule is a
    handful of rows, so the ladder stays inside generated code instead of
    a range join."""
    c = _col(date_col)
    out = F.when(c <= ts_lit(schedule.dates[0]), F.lit(schedule.rates[0]).cast(rate_type))
    for i in range(1, len(schedule.dates)):
        lo, hi = schedule.dates[i - 1], schedule.dates[i]
        out = out.when((c >= ts_lit(lo)) & (c < ts_lit(hi)), F.lit(schedule.rates[i]).cast(rate_type))
    return out.otherwise(F.lit(None).cast(rate_type))
