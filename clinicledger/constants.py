"""Fixed values the reports must use verbatim to give the same results.

Everything here is data (codes, ids, labels, dates, rates), listed in the
order the reports use it. Logic lives in ``functions`` and ``operators``.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

# ---------------------------------------------------------------------------
# FIXED VALUES - revenue journal
# ---------------------------------------------------------------------------
# Provider types that make up a resource label.
PROVIDER_TYPES = ("Doctors", "BHC", "Dentists", "Hygienists")
MULTIPLE_LABEL = "(Multiple)"
# Resource subtypes left out of collections (Prenatal Provider, etc.).
EXCLUDED_RESOURCE_SUBTYPES = (2460, 2461, 2452)
# Payment routing: PaymentMethod.Source and Transactions.Action codes.
SOURCE_PATIENT = 1
SOURCE_INSURANCE = 2
ACTION_PAYMENT = "P"
ACTION_ADJUSTMENT = "A"
# Adjustment-type FunctionName flags (a missing flag counts as collectable).
COLLECTABLE_FLAG = "Y"
NON_COLLECTABLE_FLAG = "N"
# Resource / resource type / service type labels.
PLB_PROVIDER = "PLB, Provider"
PLB_TYPE = "PLB"
NONE_LABEL = "None"
NONE_ERROR_LABEL = "None/Error"
OTHER_NON_BILLABLE = "Other/Non-Billable"
SERVICE_TYPES = (("BHC", ("BHC",)), ("Medical", ("Doctors",)), ("Dental", ("Dentists", "Hygienists")))
OTHER_ERROR = "Other/Error"
UNKNOWN_LABEL = "Unknown"
SELF_PAY_LABEL = "Self Pay"
# Broad payer type by policy type id, first match wins.
BROAD_PAYER_TYPES = (
    ("Medicaid/PPS", (2495, 114348)),
    ("Self Pay/Sliding Fee", (2500, 2501)),
    ("Medicare", (2497, 114349, 146)),
)
OTHER_PAYER_TYPE = "Private/Other"
# Effective dates of the Medicaid PPS rate and the rates (a rate applies from
# its date up to the next date; before the first date the first rate
# applies, including the first date itself). Rates after 2017 are unset.
PPS_RATE_DATES = (
    dt.datetime(2015, 10, 1),
    dt.datetime(2016, 10, 1),
    dt.datetime(2017, 10, 1),
    dt.datetime(2018, 10, 1),
)
PPS_RATES = (Decimal("193.95"), Decimal("195.50"), Decimal("197.65"), None)

# ---------------------------------------------------------------------------
# FIXED VALUES - encounter report
# ---------------------------------------------------------------------------
# Default report window (one quarter; the end is the last datetime tick).
ENCOUNTER_START = dt.datetime(2017, 1, 1)
ENCOUNTER_END = dt.datetime(2017, 3, 31, 23, 59, 59, 997000)
# Flat-rate visit codes: insurance allocation is booked as an adjustment.
FLAT_RATE_CPT_CODES = ("520", "T1015", "900", "D2999")
NO_CODE_LABEL = "No Code"
# Place-of-service codes per encounter kind.
OFFICE_POS = ("11", "04", "50")
INPATIENT_POS = ("21", "22")
NOT_OTHER_POS = ("11", "04", "21", "22")
HOME_POS = ("12",)
# Qualifier prefixes: 8 characters for reversals, 10 for encounters.
REVERSAL_PREFIXES = ("HCPC - M", "HCPC - D", "HCPC - B")
ENCOUNTER_PREFIXES = ("HCPC - MED", "HCPC - DEN", "HCPC - BH")
# Procedure codes that never count as an encounter.
NON_ENCOUNTER_CODES = ("90832UL", "96150", "96151", "96152", "90867BH", "98966BH")
# Test patients: last names containing any of these.
TEST_PATIENT_MARKERS = ("Mouse", "Test", "Vistest")
DATA_SOURCE = "Centricity"
# Tickets left out of the encounter report.
EXCLUDED_TICKETS = (
    "000347", "000842A", "006186", "010976",
    "021547", "023971", "033918", "043091", "045260A", "051951", "054196",
    "057663", "057664", "057665", "057666", "061326", "002746", "004112",
    "005342", "006032", "012802", "013967", "013973", "016045", "016206",
    "017547", "018425", "019487", "020016", "020685", "020713", "021249",
    "021546", "026112", "027993", "028781", "029520", "031820", "033010",
    "033377", "044270", "045973", "051922", "051966", "051991", "054189",
    "056586", "056587", "057476", "057625", "057643", "059386", "061308",
    "061312", "061313", "061314", "062677", "063810", "063811", "063816",
    "063819", "063821", "063829", "063835", "063836", "063840", "063848",
    "079063", "000236", "000637", "001189", "001210", "001211", "001884",
    "002118", "002222A", "004680", "008323", "008673", "011702", "012921",
    "013322", "013868", "013950", "016196", "016449", "017509", "021799",
    "023132", "023968", "023990", "024005", "024981", "028422", "033069",
    "033332", "035577", "039397", "042398", "043316", "046141", "046142",
    "046235", "048285", "051929", "051932", "051934", "051936", "051957",
    "051960", "051980", "052012", "052017", "052028", "052694", "052696",
    "054190", "054236", "056055", "057638", "057644", "057672", "058772",
    "058829", "058839", "060536", "060546", "060581", "060701", "061323",
    "063306", "063404", "063405", "063846", "063856", "045265", "059952",
)
# Declared lengths of the staged ledger's text columns (varchar(n)).
LEDGER_TEXT_LENGTHS = {
    "doctor_name": 60,
    "facility_name": 60,
    "company_name": 60,
    "policy_type": 90,
    "insurance_carrier": 60,
    "cpt_code": 10,
    "ticket_number": 35,
    "month_of_service": 7,
    "patient_id": 20,
    "hcpc": 200,
}
# Void visits carry this marker in their description (filter is off by default).
VOID_MARKER = "*VOID*"

# ---------------------------------------------------------------------------
# FIXED VALUES - incentive payments
# ---------------------------------------------------------------------------
INCENTIVE_PATIENT_ID = "48798"
