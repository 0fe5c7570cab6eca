"""Report parameters as frozen dataclasses of plain values.

Parameters become literals in the plan (``F.lit``), never runtime
variables, so Catalyst folds every unset optional filter away and pushes
the date windows down to the scans. The report run date is a parameter too:
reruns give identical results.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from clinicledger.constants import (
    ENCOUNTER_END,
    ENCOUNTER_START,
    EXCLUDED_TICKETS,
    INCENTIVE_PATIENT_ID,
    TEST_PATIENT_MARKERS,
)
from clinicledger.functions.classify import RateSchedule
from clinicledger.functions.dates import rolling_months
from clinicledger.operators.ledger import LedgerFilter


@dataclass(frozen=True)
class EncounterParams:
    """Encounter report parameters (one quarter by default)."""

    start: dt.datetime | None = ENCOUNTER_START
    end: dt.datetime | None = ENCOUNTER_END
    date_type: str = "DOS"  # 'DOS' service date, 'DOE' entry date
    include_resource: int = 1  # 1 = rollup with resources; other values produce no rows
    doctors: Sequence[int] | None = None
    procedures: Sequence[int] | None = None
    facilities: Sequence[int] | None = None
    companies: Sequence[int] | None = None
    carriers: Sequence[int] | None = None
    batches: Sequence[int] | None = None
    resources: Sequence[int] | None = None
    excluded_tickets: Sequence[str] = EXCLUDED_TICKETS
    test_patient_markers: Sequence[str] = TEST_PATIENT_MARKERS
    ignore_case: bool = True
    ordered: bool = True

    def ledger_filter(self) -> LedgerFilter:
        return LedgerFilter(
            start=self.start, end=self.end, date_type=self.date_type, doctors=self.doctors,
            procedures=self.procedures, facilities=self.facilities, companies=self.companies,
            carriers=self.carriers, batches=self.batches,
            test_patient_markers=self.test_patient_markers, ignore_case=self.ignore_case,
        )


@dataclass(frozen=True)
class RevenueParams:
    """Revenue journal parameters."""

    start: dt.datetime | None
    end: dt.datetime | None
    closing: dt.datetime  # current closing date (with time)
    cutoff: dt.date  # last entry date of subsequent collections
    report_date: dt.datetime
    date_type: str = "DOS"
    rates: RateSchedule = field(default_factory=RateSchedule)
    facilities: Sequence[int] | None = None
    carriers: Sequence[int] | None = None
    # 'reference': collections counted once per visit resource x type row
    # (as the report text does); 'distinct': once per procedure line.
    fanout: str = "reference"
    ordered: bool = True

    @classmethod
    def rolling(cls, as_of: dt.datetime, months: int = 12, **kw) -> "RevenueParams":
        """The usual run: rolling ``months`` before ``as_of``, closing and
        cut-off at ``as_of``, stamped with ``as_of``."""
        start, end = rolling_months(as_of, months)
        kw.setdefault("closing", as_of)
        kw.setdefault("cutoff", as_of.date() if isinstance(as_of, dt.datetime) else as_of)
        kw.setdefault("report_date", as_of)
        return cls(start=start, end=end, **kw)


@dataclass(frozen=True)
class VisitPaymentParams:
    patient_id: str = INCENTIVE_PATIENT_ID
