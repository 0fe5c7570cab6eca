"""Schemas of the 16 billing tables, the ``Tables`` bundle and loaders.

Base-table types are our choice (the report scripts declare none); money is
``decimal(10,2)``, timestamps are ``timestamp_ntz``, keys are ``bigint``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(10,2)"

TABLE_SCHEMAS: dict[str, str] = {
    "patient_profile": "patient_profile_id bigint, patient_id string, last string",
    "patient_visit": (
        "patient_visit_id bigint, patient_profile_id bigint, ticket_number string, "
        "doctor_id bigint, facility_id bigint, company_id bigint, "
        "primary_insurance_carriers_id bigint, visit timestamp_ntz, "
        "entered timestamp_ntz, first_filed_date timestamp_ntz"
    ),
    "doctor_facility": (
        "doctor_facility_id bigint, list_name string, dot_id string, "
        "place_of_service_mid bigint"
    ),
    "med_lists": "med_lists_id bigint, description string, code string, function_name string",
    "insurance_carriers": "insurance_carriers_id bigint, list_name string, policy_type_mid bigint",
    "procedures": "procedures_id bigint, department_mid bigint, cpt_procedure_code_qualifier_mid bigint",
    "batch": "batch_id bigint",
    "patient_visit_procs": (
        "patient_visit_procs_id bigint, patient_visit_id bigint, procedures_id bigint, "
        "batch_id bigint, code string, cpt_code string, units double, "
        "date_of_service_from timestamp_ntz, date_of_entry timestamp_ntz, "
        f"total_allowed {MONEY}"
    ),
    "patient_visit_procs_agg": (
        "patient_visit_procs_id bigint, patient_visit_id bigint, "
        f"ins_allocation {MONEY}, pat_allocation {MONEY}, ins_adjustment {MONEY}, "
        f"pat_adjustment {MONEY}, orig_ins_allocation {MONEY}, orig_pat_allocation {MONEY}"
    ),
    "patient_visit_agg": f"patient_visit_id bigint, patient_profile_id bigint, ins_payment {MONEY}",
    "patient_visit_resource": "patient_visit_resource_id bigint, patient_visit_id bigint, resource_id bigint",
    "resource_type_assignments": "resource_id bigint, resource_type_id bigint",
    "payment_method": (
        "payment_method_id bigint, batch_id bigint, source int, check_card_number string, "
        "check_date timestamp_ntz, payer_type string, date_of_entry timestamp_ntz"
    ),
    "visit_transactions": "visit_transactions_id bigint, patient_visit_id bigint, payment_method_id bigint",
    "transactions": "transactions_id bigint, visit_transactions_id bigint, action string, action_type_mid bigint",
    "transaction_distributions": f"transactions_id bigint, patient_visit_procs_id bigint, amount {MONEY}",
}

# Keys the plans assume unique (semi-join rewrites of existence joins and
# dropped unused outer joins rely on them).
UNIQUE_KEYS: dict[str, tuple[str, ...]] = {
    "patient_profile": ("patient_profile_id",),
    "patient_visit": ("patient_visit_id",),
    "doctor_facility": ("doctor_facility_id",),
    "med_lists": ("med_lists_id",),
    "insurance_carriers": ("insurance_carriers_id",),
    "procedures": ("procedures_id",),
    "batch": ("batch_id",),
    "patient_visit_resource": ("patient_visit_resource_id",),
    "patient_visit_procs": ("patient_visit_procs_id",),
    "patient_visit_procs_agg": ("patient_visit_procs_id",),
    "payment_method": ("payment_method_id",),
    "visit_transactions": ("visit_transactions_id",),
    "transactions": ("transactions_id",),
}

@dataclass(frozen=True)
class Tables:
    """The billing tables as DataFrames (one field per table)."""

    patient_profile: DataFrame
    patient_visit: DataFrame
    doctor_facility: DataFrame
    med_lists: DataFrame
    insurance_carriers: DataFrame
    procedures: DataFrame
    batch: DataFrame
    patient_visit_procs: DataFrame
    patient_visit_procs_agg: DataFrame
    patient_visit_agg: DataFrame
    patient_visit_resource: DataFrame
    resource_type_assignments: DataFrame
    payment_method: DataFrame
    visit_transactions: DataFrame
    transactions: DataFrame
    transaction_distributions: DataFrame
    # heavy key values by key column, and rows of bucketed tables stored apart
    # under them (see operators.skew); filled for stored layouts
    heavy: dict = field(default_factory=dict, compare=False, repr=False)
    _in_place: dict = field(default_factory=dict, compare=False, repr=False)
    # shares of derived tables, made from a share of their source (see share)
    _shares: dict = field(default_factory=dict, compare=False, repr=False)
    # memo of dimension size checks, see operators.dims.dim
    _checked: dict = field(default_factory=dict, compare=False, repr=False)
    # memo of parameter-free plan fragments (lazy DataFrames, not data)
    _plans: dict = field(default_factory=dict, compare=False, repr=False)

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls) if f.name in TABLE_SCHEMAS]

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def parts(self, name: str) -> tuple[DataFrame, DataFrame | None]:
        """Table ``name`` as its rows in place and those stored apart, if any."""
        return self._in_place.get(name, (self.table(name), None))

    def share(self, name: str, by: str, k: int, n: int) -> DataFrame:
        """Share ``k`` of ``n`` shares of table ``name``: each row is in one of
        them. A derived table's share is made from a share of its source where
        the mapping allows it, else rows are dealt by the hash of column ``by``."""
        if n == 1:
            return self.table(name)
        if name in self._shares:
            return self._shares[name](k, n)
        return self.table(name).filter(F.pmod(F.xxhash64(by), F.lit(n)) == k)

    @property
    def spark(self) -> SparkSession:
        return self.patient_visit.sparkSession

    def memo(self, key, build):
        """Build a parameter-free plan fragment once per ``Tables`` and reuse
        the same (lazy) DataFrame: saves re-building and re-analysing it in
        every report; each action still runs the whole plan."""
        if key not in self._plans:
            self._plans[key] = build()
        return self._plans[key]


def schema_of(spark: SparkSession, name: str):
    """Declared schema of table ``name`` as a StructType."""
    return spark.createDataFrame([], TABLE_SCHEMAS[name]).schema


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select and cast ``df`` to the declared schema of table ``name``."""
    schema = schema_of(df.sparkSession, name)
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def load_tables(spark: SparkSession, base_dir: str, fmt: str = "parquet", check_keys: bool = False) -> Tables:
    """Read the 16 tables from ``{base_dir}/{table}`` with declared schemas;
    ``check_keys`` asserts the unique keys (once, here).

    Column pruning and filter pushdown reach the scan: the plans only ever
    select the columns they read.
    """
    frames = {
        name: spark.read.format(fmt).schema(TABLE_SCHEMAS[name]).load(f"{base_dir}/{name}")
        for name in TABLE_SCHEMAS
    }
    tables = Tables(**frames)
    if check_keys:
        assert_unique_keys(tables)
    return tables


def duplicate_keys(tables: Tables, name: str) -> DataFrame:
    """Rows of key values occurring more than once in table ``name``."""
    keys = list(UNIQUE_KEYS[name])
    return (
        tables.table(name)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )


def assert_unique_keys(tables: Tables, names: tuple[str, ...] | None = None) -> None:
    """Fail when a key the plans assume unique is duplicated (distributed
    check: one aggregation per table, at most one row reaches the driver)."""
    for name in names or tuple(UNIQUE_KEYS):
        dup = duplicate_keys(tables, name).limit(1).collect()
        if dup:
            raise ValueError(f"table {name}: duplicate key {dup[0].asDict()}")
