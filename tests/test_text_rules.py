"""Comparison rules of the report database (case, trailing blanks), the
written report's manifest, and orders with many lines."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from clinicledger.constants import EXCLUDED_TICKETS
from clinicledger.functions import classify, money, text
from clinicledger.operators import filters, resources
from clinicledger.operators.collections import pivot_expressions
from clinicledger.operators.ledger import route_payments
from clinicledger.sources import sinks
from tests.conftest import SMOKE_DIR, rows

# base spelling, other spellings that are equal, spellings that are not
SPELLINGS = [("AbC", ["abc", "ABC  ", "AbC"], [" abc", "ab c", "abcd", "ab", ""])]


def _ids(df):
    return [r[0] for r in rows(df, "id")]


def test_text_equals_and_in(spark):
    for base, same, other in SPELLINGS:
        df = spark.createDataFrame(list(enumerate([*same, *other, None])), "id int, v string")
        assert _ids(df.filter(text.text_equals("v", base))) == list(range(len(same)))
        assert _ids(df.filter(text.text_in("v", [base, "zz"]))) == list(range(len(same)))
        # NULL stays unknown under NOT
        assert _ids(df.filter(~text.text_in("v", [base]))) == list(range(len(same), len(same) + len(other)))


def test_text_equals_of_a_number_reaches_the_scan(spark):
    df = spark.read.parquet(f"{SMOKE_DIR}/customer.parquet").select(F.col("c_name").alias("v"))
    plan = df.filter(text.text_equals("v", "48"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(v" in plan or "StringStartsWith(c_name" in plan
    named = spark.createDataFrame([(1, "48"), (2, "48 "), (3, "480"), (4, None), (5, " 48")], "id int, v string")
    assert _ids(filters.equals(named, "v", "48")) == [1, 2]
    assert _ids(filters.equals(named, "id", 3)) == [3]


def test_exclude_keys_by_the_rules_in_every_form(spark, monkeypatch):
    df = spark.createDataFrame([(1, "000842a"), (2, "000842A "), (3, "000842B"), (4, None), (5, "")], "id int, v string")
    keys = spark.createDataFrame([("000842A",), (None,)], "k string")
    assert _ids(filters.exclude_keys(df, "v", ["000842A"])) == [3, 5]
    assert _ids(filters.exclude_keys(df, "v", keys)) == [3, 5]
    monkeypatch.setattr(filters, "INLINE_LIST_MAX", 0)
    assert _ids(filters.exclude_keys(df, "v", ["000842A"])) == [3, 5]
    assert _ids(filters.exclude_keys(df.withColumn("n", F.col("id") * 2), "n", [4, 6])) == [1, 4, 5]
    assert len(EXCLUDED_TICKETS) == 137


def test_exact_part_of_the_exclusion_reaches_the_scan(spark):
    df = spark.read.parquet(f"{SMOKE_DIR}/customer.parquet").select(F.col("c_name").alias("v"))
    plan = filters.exclude_keys(df, "v", ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(" in plan and "Not(In(" in plan


def test_code_lists_by_the_rules(spark):
    codes = ["t1015 ", "T1015", "t1015x", None]
    df = spark.createDataFrame(list(enumerate(codes)), "id int, c string")
    got = rows(df.select("id", money.flat_rate_ins_allocation("c", F.lit(7)).alias("a")), "id", "a")
    assert [a for _, a in got] == [0, 0, 7, 7]
    lines = spark.createDataFrame(
        [(1, "hcpc - med", 1, "90832ul"), (2, "HCPC - BH visit", 1, "x"), (3, "hcpc - m", -1, "x"), (4, "HCPC - MED", 1, None)],
        "id int, q string, u int, c string")
    flags = rows(lines.select("id", money.line_encounter("q", "u", "c").alias("s")), "id", "s")
    assert [s for _, s in flags] == [0, 1, -1, 0]


def test_collectability_and_actions_by_the_rules(spark):
    df = spark.createDataFrame([(1, "y "), (2, "n"), (3, "N  "), (4, "x"), (5, None)], "id int, f string")
    assert _ids(df.filter(classify.is_collectable("f"))) == [1, 5]
    assert _ids(df.filter(classify.is_non_collectable("f"))) == [2, 3]
    moves = spark.createDataFrame([(1, 2, "p ", 5, "y"), (2, 1, "a", 3, "n "), (3, 2, "t", 9, None)],
                                  "id int, source int, action string, amount int, function_name string")
    routed = rows(moves.select("id", *[c.alias(k) for k, c in route_payments().items()]),
                  "id", "ins_payment", "pat_adjustment", "pat_balance")
    assert routed == [(1, 5, 0, 0), (2, 0, 3, -3), (3, 0, 0, 0)]
    sums = moves.agg(*[c.alias(k) for k, c in pivot_expressions().items()]).first().asDict()
    assert sums["insurance_payment"] == 5 and sums["non_collectable_patient_adjustment"] == 3


def test_provider_types_by_the_rules(spark, make_tables):
    t = make_tables(
        doctor_facility=[(1, "Dr One", "D1", None)], med_lists=[(2400, "doctors ", None, None), (2401, "bhc", None, None)],
        resource_type_assignments=[(1, 2400), (1, 2401)], patient_visit_resource=[(1001, 100, 1), (1002, 200, 1)])
    assert rows(resources.visit_resource_types(t), "resource_type") == [("bhc",), ("bhc",), ("doctors ",), ("doctors ",)]
    assert rows(resources.visit_resource_profile(t)) == [(100, 2, 1), (200, 2, 1)]


def test_manifest_tells_order(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 2).alias("m"), F.when(F.col("id") > 3, F.col("id")).alias("k"))
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    sinks.write_report(df, good, partition_by=("m",), sort_by=("k",), max_records_per_file=60)
    files = sinks.report_manifest(spark, good, ["k"], ["m"]).collect()
    assert all(f["ascends"] for f in files) and sum(f["n_rows"] for f in files) == 1000 and len(files) > 10
    placed = rows(sinks.report_positions(spark, good, ["k"], ["m"]), "m", "position", "k")
    for m in (0, 1):
        mine = [(p, k) for m_, p, k in placed if m_ == m]
        assert [p for p, _ in mine] == list(range(1, 501))
        assert [k or -1 for _, k in mine] == sorted(k or -1 for _, k in mine)
    df.repartition(4).write.partitionBy("m").parquet(bad)
    assert not all(f["ascends"] for f in sinks.report_manifest(spark, bad, ["k"], ["m"]).collect())
    empty = str(tmp_path / "empty")
    df.filter("m > 5").write.parquet(empty)
    assert sinks.report_manifest(spark, empty, ["k"], []).count() == 0


def test_an_order_of_many_lines_keeps_its_ids_apart(spark, tmp_path):
    import os
    import shutil

    from clinicledger.sources.fixture import fixture_tables
    from sqloracle.fixture import FIXTURE_CTE

    for name in os.listdir(SMOKE_DIR):
        if name != "lineitem.parquet":
            shutil.copy(f"{SMOKE_DIR}/{name}", tmp_path / name)
    con = duckdb.connect()
    # two orders side by side, one of 300 lines
    con.sql(f"COPY (SELECT * REPLACE (CASE WHEN n <= 300 THEN 7 ELSE 8 END AS l_orderkey) FROM (SELECT *, row_number() OVER () n "
            f"FROM '{SMOKE_DIR}/lineitem.parquet') WHERE n <= 340) TO '{tmp_path}/lineitem.parquet'")
    lines = fixture_tables(spark, str(tmp_path)).patient_visit_procs
    got = rows(lines, "patient_visit_procs_id", "patient_visit_id")
    assert len({i for i, _ in got}) == 340 and sorted({v for _, v in got}) == [7, 8]
    for name in os.listdir(tmp_path):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{tmp_path}/{name}'")
    want = con.sql(FIXTURE_CTE + " SELECT patient_visit_procs_id, patient_visit_id FROM patient_visit_procs").fetchall()
    assert got == sorted(want)
