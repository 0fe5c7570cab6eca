"""Billing tables derived from the driver's TPC-H-style test tables.

The report scripts ship no sample data, so the 16 billing tables are mapped
from ``customer orders lineitem part supplier nation region`` (FIXTURES.md
section 3). The mapping is a plain Spark plan: it grows with the input and is
pruned and pushed down like any other scan. The same mapping is written
independently in DuckDB SQL for the oracle (``sqloracle/fixture.py``).

Grain: orders -> visits, lineitem -> procedure lines (+ their aggregates and
three payment distributions each), part -> procedures/batches,
supplier -> doctors/resources, nation -> facilities/carriers,
region -> companies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinicledger.sources.tables import MONEY, Tables, conform

# ---------------------------------------------------------------------------
# Fixed values of the mapping (test-data choices; ids of policy types, place
# codes, resource types and qualifiers are those the reports test for).
# ---------------------------------------------------------------------------
MED_LISTS_ROWS = [
    # (med_lists_id, description, code, function_name)
    # policy types
    (2495, "Medicaid", None, None),
    (114348, "Medicaid Managed Care", None, None),
    (2500, "Self Pay", None, None),
    (2501, "Sliding Fee", None, None),
    (2497, "Medicare", None, None),
    (114349, "Medicare Advantage", None, None),
    (146, "Medicare Part B", None, None),
    (9001, "Commercial", None, None),
    # resource types
    (2400, "Doctors", None, None),
    (2401, "BHC", None, None),
    (2402, "Dentists", None, None),
    (2403, "Hygienists", None, None),
    (2404, "Nurses", None, None),
    (2460, "Prenatal Provider", None, None),
    # places of service
    (300, "Office", "11", None),
    (301, "Homeless Shelter", "04", None),
    (302, "Federally Qualified Health Center", "50", None),
    (303, "Inpatient Hospital", "21", None),
    (304, "Outpatient Hospital", "22", None),
    (305, "Home", "12", None),
    (306, "Other Place of Service", "99", None),
    # procedure code qualifiers
    (400, "HCPC - MED", None, None),
    (401, "HCPC - DEN", None, None),
    (402, "HCPC - BH", None, None),
    (403, "HCPC - BH visit", None, None),
    (404, "HCPC - MISC", None, None),
    (405, "CPT - LAB", None, None),
    # departments
    (500, "Medical", None, None),
    (501, "Dental", None, None),
    (502, "Behavioral Health", None, None),
    (503, "Administration", None, None),
    # adjustment types
    (600, "Contractual Adjustment", None, "Y"),
    (601, "Write Off", None, "N"),
    (602, "Other Adjustment", None, None),
]
# insurance carrier policy type by nation key % 10 (None = no policy type)
CARRIER_POLICY_BY_MOD10 = [2495, 114348, 2500, 2501, 2497, 114349, 146, 9001, 9002, None]
# procedure line code by part key % 16 (keys 4..15 map to '992' + two digits)
LINE_CODE_BY_MOD16 = {0: "90832UL", 1: "96150", 2: "98966BH", 3: None}
# procedure line CPT code by part key % 12 (keys 5..11 map to '99213')
LINE_CPT_BY_MOD12 = {0: "520", 1: "T1015", 2: "900", 3: "D2999", 4: None}
# visits whose ticket number gets an 'A' suffix
TICKET_A_SUFFIX_KEYS = [842, 2222, 45260]
PLB_SUPPLIER_KEY = 9
PLB_NAME = "PLB, Provider"
FACILITY_ID_BASE = 1_000_000
# line ids of an order start a step apart; row numbers are 32-bit
LINE_ID_STEP = 1 << 31
COMPANY_ID_BASE = 2_000_000


def _days(n: int) -> Column:
    return F.expr(f"INTERVAL '{n}' DAY")


def _ladder(key: Column, mapping: dict, default: Column) -> Column:
    expr = None
    for k, v in mapping.items():
        value = F.lit(v).cast("string")
        expr = F.when(key == k, value) if expr is None else expr.when(key == k, value)
    return expr.otherwise(default)


def _lines(lineitem: DataFrame) -> DataFrame:
    """lineitem with a unique procedure-line id ``pid`` and decimal money.

    ``(l_orderkey, l_linenumber)`` is not unique in the test data, so the id
    numbers the lines of an order in a total order. The window partitions by
    order key (at most 17 lines an order at every test size); a number stays
    below ``LINE_ID_STEP`` in any order, so ids of two orders never meet.
    """
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"
    )
    return lineitem.select(
        "*",
        (F.col("l_orderkey") * LINE_ID_STEP + F.row_number().over(order)).alias("pid"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
        F.col("l_discount").cast("decimal(4,2)").alias("disc"),
        (F.col("l_linenumber") % 4 != 0).alias("ins_line"),
    )


def _order_tables(orders: DataFrame) -> dict[str, DataFrame]:
    """The tables mapped from rows of ``orders``, each row by itself."""
    ok = F.col("o_orderkey")
    patient_visit = orders.select(
        ok.alias("patient_visit_id"),
        F.col("o_custkey").alias("patient_profile_id"),
        F.when(ok % 101 == 0, F.lit(None).cast("string"))
        .otherwise(
            F.concat(
                F.format_string("%06d", ok),
                F.when(ok.isin(TICKET_A_SUFFIX_KEYS), F.lit("A")).otherwise(F.lit("")),
            )
        )
        .alias("ticket_number"),
        (ok % 10).alias("doctor_id"),
        (F.col("o_custkey") % 25 + FACILITY_ID_BASE).alias("facility_id"),
        (F.col("o_custkey") % 5 + COMPANY_ID_BASE).alias("company_id"),
        F.when(ok % 11 == 0, F.lit(None).cast("bigint")).otherwise(ok % 25).alias(
            "primary_insurance_carriers_id"
        ),
        F.col("o_orderdate").alias("visit"),
        (F.col("o_orderdate") + _days(1)).alias("entered"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("timestamp_ntz"))
        .otherwise(F.col("o_orderdate") + _days(3))
        .alias("first_filed_date"),
    )

    patient_visit_agg = orders.select(
        ok.alias("patient_visit_id"),
        F.col("o_custkey").alias("patient_profile_id"),
        F.col("o_totalprice").cast(MONEY).alias("ins_payment"),
    )

    patient_visit_resource = (
        orders.filter(ok % 13 != 0)
        .select((ok * 10 + 1).alias("patient_visit_resource_id"), ok.alias("patient_visit_id"), (ok % 10).alias("resource_id"))
        .unionByName(
            orders.filter(ok % 5 == 0).select(
                (ok * 10 + 2).alias("patient_visit_resource_id"),
                ok.alias("patient_visit_id"),
                ((ok + 3) % 10).alias("resource_id"),
            )
        )
    )

    # one payment method / visit transaction per order and source (s=0 patient, s=1 insurance)
    orders_by_source = orders.withColumn("s", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")))
    vt_id = ok * 2 + F.col("s")
    payment_method = orders_by_source.select(
        vt_id.alias("payment_method_id"),
        (ok % 50).alias("batch_id"),
        (F.col("s") + 1).cast("int").alias("source"),
        F.concat(F.lit("CK"), ok.cast("string")).alias("check_card_number"),
        (F.col("o_orderdate") + _days(30)).alias("check_date"),
        F.when(F.col("s") == 0, F.lit("Patient")).otherwise(F.lit("Insurance")).alias("payer_type"),
        (F.col("o_orderdate") + _days(35)).alias("date_of_entry"),
    )
    visit_transactions = orders_by_source.select(
        vt_id.alias("visit_transactions_id"), ok.alias("patient_visit_id"), vt_id.alias("payment_method_id")
    )
    # three transactions per visit transaction: a=0 payment, 1 adjustment, 2 transfer
    three = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)).cast("array<bigint>"))
    transactions = orders_by_source.withColumn("a", three).select(
        (vt_id * 3 + F.col("a")).alias("transactions_id"),
        vt_id.alias("visit_transactions_id"),
        F.when(F.col("a") == 0, F.lit("P")).when(F.col("a") == 1, F.lit("A")).otherwise(F.lit("T")).alias("action"),
        F.when(F.col("a") == 1, ok % 4 + 600).otherwise(F.lit(None).cast("bigint")).alias("action_type_mid"),
    )
    return {
        "patient_visit": patient_visit,
        "patient_visit_agg": patient_visit_agg,
        "patient_visit_resource": patient_visit_resource,
        "payment_method": payment_method,
        "visit_transactions": visit_transactions,
        "transactions": transactions,
    }


def _line_tables(lineitem: DataFrame) -> dict[str, DataFrame]:
    """The tables mapped from rows of ``lineitem``, each order's by themselves."""
    zero = F.lit(0).cast(MONEY)
    lines = _lines(lineitem)
    pk = F.col("l_partkey")
    service = F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_linenumber") * 3)
    patient_visit_procs = lines.select(
        F.col("pid").alias("patient_visit_procs_id"),
        F.col("l_orderkey").alias("patient_visit_id"),
        F.when(pk % 53 == 0, F.lit(None).cast("bigint")).otherwise(pk).alias("procedures_id"),
        (pk % 50).alias("batch_id"),
        _ladder(
            pk % 16, LINE_CODE_BY_MOD16, F.concat(F.lit("992"), F.format_string("%02d", pk % 16))
        ).alias("code"),
        _ladder(pk % 12, LINE_CPT_BY_MOD12, F.lit("99213")).alias("cpt_code"),
        F.when(
            (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), -F.col("l_quantity")
        )
        .otherwise(F.col("l_quantity"))
        .alias("units"),
        service.alias("date_of_service_from"),
        (service + _days(5)).alias("date_of_entry"),
        F.col("price").alias("total_allowed"),
    )

    ins = F.col("ins_line")
    orig_ins = F.when(ins, F.col("price")).otherwise(zero)
    orig_pat = F.when(ins, zero).otherwise(F.col("price"))
    no_disc = F.col("disc") == 0
    adj = (F.col("price") * F.col("disc")).cast(MONEY)
    patient_visit_procs_agg = lines.select(
        F.col("pid").alias("patient_visit_procs_id"),
        F.col("l_orderkey").alias("patient_visit_id"),
        F.when(no_disc, zero).otherwise(orig_ins).alias("ins_allocation"),
        F.when(no_disc, zero).otherwise(orig_pat).alias("pat_allocation"),
        F.when(ins, adj).otherwise(zero).alias("ins_adjustment"),
        F.when(ins, zero).otherwise(adj).alias("pat_adjustment"),
        orig_ins.alias("orig_ins_allocation"),
        orig_pat.alias("orig_pat_allocation"),
    )

    three = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)).cast("array<bigint>"))
    base_s = F.when(ins, F.lit(1)).otherwise(F.lit(0))
    flip = (F.col("a") == 1) & (F.col("pid") % 3 == 0)
    s = F.when(flip, 1 - base_s).otherwise(base_s)
    amount = (
        F.when(F.col("l_tax") == 0, zero)
        .when(F.col("a") == 0, (F.col("price") * (1 - F.col("disc"))).cast(MONEY))
        .when(F.col("a") == 1, (F.col("price") * F.col("disc")).cast(MONEY))
        .otherwise(F.lit(1).cast(MONEY))
    )
    transaction_distributions = lines.withColumn("a", three).select(
        ((F.col("l_orderkey") * 2 + s) * 3 + F.col("a")).alias("transactions_id"),
        F.col("pid").alias("patient_visit_procs_id"),
        amount.alias("amount"),
    )
    return {
        "patient_visit_procs": patient_visit_procs,
        "patient_visit_procs_agg": patient_visit_procs_agg,
        "transaction_distributions": transaction_distributions,
    }


def _share(df: DataFrame, column: str, k: int, n: int) -> DataFrame:
    return df.filter(F.pmod(F.xxhash64(column), F.lit(n)) == k)


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Map the driver's test tables under ``sf_dir`` to the billing tables."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    customer, orders, lineitem = read("customer"), read("orders"), read("lineitem")
    part, supplier, nation, region = read("part"), read("supplier"), read("nation"), read("region")

    ck = F.col("c_custkey")
    patient_profile = customer.select(
        ck.alias("patient_profile_id"),
        ck.cast("string").alias("patient_id"),
        F.when(ck % 50 == 7, F.lit("Mouse, M"))
        .when(ck % 50 == 17, F.lit("TEST, A"))
        .when(ck % 50 == 27, F.lit("Vistest"))
        .when(ck % 50 == 37, F.lit(None).cast("string"))
        .otherwise(F.col("c_name"))
        .alias("last"),
    )

    sk = F.col("s_suppkey")
    doctor_facility = (
        supplier.select(
            sk.alias("doctor_facility_id"),
            F.when(sk == PLB_SUPPLIER_KEY, F.lit(PLB_NAME)).otherwise(F.col("s_name")).alias("list_name"),
            F.concat(F.lit("D"), sk.cast("string")).alias("dot_id"),
            F.lit(None).cast("bigint").alias("place_of_service_mid"),
        )
        .unionByName(
            nation.select(
                (F.col("n_nationkey") + FACILITY_ID_BASE).cast("bigint").alias("doctor_facility_id"),
                F.col("n_name").alias("list_name"),
                F.lit(None).cast("string").alias("dot_id"),
                (F.col("n_nationkey") % 8 + 300).cast("bigint").alias("place_of_service_mid"),
            )
        )
        .unionByName(
            region.select(
                (F.col("r_regionkey") + COMPANY_ID_BASE).cast("bigint").alias("doctor_facility_id"),
                F.col("r_name").alias("list_name"),
                F.lit(None).cast("string").alias("dot_id"),
                F.lit(None).cast("bigint").alias("place_of_service_mid"),
            )
        )
    )

    med_lists = spark.createDataFrame(
        MED_LISTS_ROWS, "med_lists_id bigint, description string, code string, function_name string"
    )

    nk = F.col("n_nationkey")
    policy = None
    for i, pid in enumerate(CARRIER_POLICY_BY_MOD10):
        value = F.lit(pid).cast("bigint")
        policy = F.when(nk % 10 == i, value) if policy is None else policy.when(nk % 10 == i, value)
    insurance_carriers = nation.select(
        nk.cast("bigint").alias("insurance_carriers_id"),
        F.when(nk == 13, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Carrier "), F.col("n_name")))
        .alias("list_name"),
        policy.alias("policy_type_mid"),
    )

    procedures = part.select(
        F.col("p_partkey").alias("procedures_id"),
        (F.col("p_size") % 5 + 500).cast("bigint").alias("department_mid"),
        (F.col("p_size") % 7 + 400).cast("bigint").alias("cpt_procedure_code_qualifier_mid"),
    )
    batch = part.filter(F.col("p_partkey") < 49).select(F.col("p_partkey").alias("batch_id"))

    resource_type_assignments = (
        supplier.select(sk.alias("resource_id"), (sk % 5 + 2400).alias("resource_type_id"))
        .unionByName(supplier.filter(sk % 4 == 0).select(sk.alias("resource_id"), F.lit(2460).cast("bigint").alias("resource_type_id")))
        .unionByName(supplier.filter(sk % 7 == 0).select(sk.alias("resource_id"), F.lit(2401).cast("bigint").alias("resource_type_id")))
    )

    frames = {
        "patient_profile": patient_profile,
        "doctor_facility": doctor_facility,
        "med_lists": med_lists,
        "insurance_carriers": insurance_carriers,
        "procedures": procedures,
        "batch": batch,
        "resource_type_assignments": resource_type_assignments,
    }
    # an order's rows are mapped apart from all others': a share of the orders
    # maps to a share of each of these tables
    shares = {}
    for mapped, rows, key in ((_order_tables, orders, "o_orderkey"), (_line_tables, lineitem, "l_orderkey")):
        for name, df in mapped(rows).items():
            frames[name] = df
            shares[name] = lambda k, n, name=name, mapped=mapped, rows=rows, key=key: conform(
                mapped(_share(rows, key, k, n))[name], name
            )
    return Tables(**{name: conform(df, name) for name, df in frames.items()}, _shares=shares)
