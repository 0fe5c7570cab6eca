"""A third of the rows under one line, one transaction and one visit: their
rows are found, stored apart and joined apart, and every report stays."""

from __future__ import annotations

import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from clinicledger.operators import collections as coll
from clinicledger.operators import ledger, skew
from clinicledger.plans import reports
from clinicledger.plans.registry import ENCOUNTER, REVENUE
from clinicledger.sources import store
from clinicledger.sources.tables import Tables

BUCKETS = 8


@pytest.fixture(scope="module")
def skewed(spark, fixture_tables_small, tmp_path_factory):
    """The small tables with hot keys, as plain files: a line with a third of
    the distributions, a transaction with a third of the others, a visit with
    a third of the lines and another with a third of the visit resources."""
    t = fixture_tables_small
    in_window = F.col("date_of_service_from").between(ENCOUNTER.start, ENCOUNTER.end)
    hot = t.patient_visit_procs.filter(in_window).agg(F.min(skew.LINE).alias("line"), F.min(skew.VISIT).alias("visit"), F.max(skew.VISIT).alias("other")).first()
    action = t.transactions.agg(F.min(skew.TRANSACTION)).first()[0]
    third = lambda key, value: F.when(F.pmod(F.xxhash64(key), F.lit(3)) == 0, F.lit(value)).otherwise
    moved = dict(
        transaction_distributions=t.transaction_distributions.withColumn(skew.LINE, third("transactions_id", hot.line)(F.col(skew.LINE))).withColumn(
            skew.TRANSACTION, F.when(F.pmod(F.xxhash64(F.col("amount"), F.col(skew.TRANSACTION)), F.lit(3)) == 1, F.lit(action)).otherwise(F.col(skew.TRANSACTION))),
        patient_visit_procs=t.patient_visit_procs.withColumn(skew.VISIT, third(skew.LINE, hot.visit)(F.col(skew.VISIT))),
        patient_visit_procs_agg=t.patient_visit_procs_agg.withColumn(skew.VISIT, third(skew.LINE, hot.visit)(F.col(skew.VISIT))),
        patient_visit_resource=t.patient_visit_resource.withColumn(skew.VISIT, third("patient_visit_resource_id", hot.other)(F.col(skew.VISIT))),
    )
    folder = str(tmp_path_factory.mktemp("skewed"))
    for name in Tables.names():
        moved.get(name, t.table(name)).write.parquet(f"{folder}/{name}")
    from clinicledger.sources.tables import load_tables

    plain = load_tables(spark, folder)
    layout = store.store_tables(plain, f"{folder}-layout", BUCKETS, check_keys=True, least_heavy=50)
    return plain, layout, hot, action


def test_heavy_values_are_found_exactly(spark):
    df = spark.createDataFrame([(None,)] * 500 + [(1,)] * 300 + [(2,)] * 120 + [(k,) for k in range(10, 400)], "k bigint")
    assert skew.heavy_keys(df, "k", 8, 50) == [1, 2]
    assert skew.heavy_keys(df, "k", 8, 200) == [1]
    assert skew.heavy_keys(df, "k", 3, 50) == [1]
    assert skew.heavy_keys(df, "k", 8) == [] == skew.heavy_keys(df.limit(0), "k", 8, 0)


def test_summary_follows_the_chain(skewed):
    _, t, hot, action = skewed
    assert hot.line in t.heavy[skew.LINE] and action in t.heavy[skew.TRANSACTION]
    leads = t.transactions.filter(F.col(skew.TRANSACTION) == action).first()[skew.VISIT_TRANSACTION]
    assert leads in t.heavy[skew.VISIT_TRANSACTION]
    assert {hot.visit, hot.other} <= set(t.heavy[skew.VISIT])
    assert all(len(v) < 3 * BUCKETS for v in t.heavy.values())


def test_apart_and_in_place_are_the_whole_table(skewed):
    plain, t, hot, _ = skewed
    for name, key in skew.SPLIT_TABLES.items():
        light, apart = t.parts(name)
        assert rows(t.table(name)) == rows(plain.table(name))
        assert apart.filter(~F.col(key).isin(t.heavy[key])).isEmpty() and light.filter(F.col(key).isin(t.heavy[key])).isEmpty()


def test_reports_are_the_same(skewed):
    plain, t, _, _ = skewed
    for report in (
        lambda x: reports.encounter_report(x, ENCOUNTER),
        lambda x: ledger.payment_rows(x, ENCOUNTER.ledger_filter()),
        lambda x: coll.collections(x, "DOS", REVENUE.start, REVENUE.end, REVENUE.closing, REVENUE.cutoff),
    ):
        got = rows(report(t))
        assert got == rows(report(plain)) and got
    summed = lambda x: reports.revenue_journal(x, REVENUE).agg(
        F.count("*"), F.sum("charges"), F.sum("payments_to_date"), F.bit_xor(F.xxhash64("ticket_number", "resource", "charges", "payments_to_date", "cpt_code"))
    ).first()
    assert summed(t) == summed(plain)


def test_no_task_has_much_more_than_the_median(spark, skewed):
    """Rows of each task that reads or joins the distributions, in place and
    apart; the plain buckets would hold a third of them in one."""
    plain, t, hot, _ = skewed
    small_splits = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": str(BUCKETS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in small_splits}
    for k, v in small_splits.items():
        spark.conf.set(k, v)
    try:
        def tasks(df):
            return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]

        light, apart = t.parts("transaction_distributions")
        lines = t.patient_visit_procs.select(skew.LINE)
        one = skew.join_stored(t, "transaction_distributions", lambda td: td, lines)
        two = skew.join_split(t, one, t.transactions.select(skew.TRANSACTION, skew.VISIT_TRANSACTION), skew.TRANSACTION)
        median = statistics.median(tasks(light))  # rows of a bucket in place
        for part in (light, apart, one, two):
            assert max(tasks(part)) <= 3 * median
        whole = plain.transaction_distributions.repartition(BUCKETS, skew.LINE)
        assert max(tasks(whole)) > 2 * statistics.median(tasks(whole))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_rows_that_are_too_many_to_broadcast_are_salted(spark, skewed, monkeypatch):
    _, t, _, _ = skewed
    left = t.patient_visit_procs.select(skew.LINE, skew.VISIT)
    right = t.patient_visit_resource.select(skew.VISIT, "resource_id")
    for how in ("inner", "left"):
        want = rows(left.join(right, skew.VISIT, how))
        assert rows(skew.join_split(t, left, right, skew.VISIT, how=how)) == want
        with monkeypatch.context() as m:
            m.setattr(skew, "BROADCAST_ROWS", 1)
            assert rows(skew.join_split(t, left, right, skew.VISIT, how=how)) == want


# records and fingerprints

def _layout(spark, make_tables, folder, last, **more):
    return store.store_tables(make_tables(patient_profile=[(1, "p1", last)]), folder, buckets=2, **more)


def test_a_cut_record_leaves_the_one_before(spark, make_tables, tmp_path):
    folder = str(tmp_path / "layout")
    _layout(spark, make_tables, folder, "first")
    numbers = store._record_numbers(spark, folder)
    (tmp_path / "layout" / store.RECORDS / f"{numbers[0] + 1:010d}.json").write_text('{"folder": "cut')
    assert store.is_stored(spark, folder)
    assert store.open_stored(spark, folder).patient_profile.first()["last"] == "first"
    assert _layout(spark, make_tables, folder, "second").patient_profile.first()["last"] == "second"


def test_a_stop_before_the_record_leaves_the_version_before(spark, make_tables, tmp_path, monkeypatch):
    folder = str(tmp_path / "layout")
    _layout(spark, make_tables, folder, "first")
    with monkeypatch.context() as m:
        m.setattr(store, "_write_json", lambda spark, path, value, w=store._write_json: w(spark, path, value) if "_heavy" in path else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            _layout(spark, make_tables, folder, "second")
    assert store.open_stored(spark, folder).patient_profile.first()["last"] == "first"


def test_records_of_two_writers_get_numbers_of_their_own(spark, tmp_path):
    folder = str(tmp_path / "layout")
    for k in range(3):
        store._write_record(spark, folder, {"folder": f"v{k}"})
    assert store._record_numbers(spark, folder) == [3, 2, 1]
    assert not store._write_json(spark, store._record_path(folder, 2), {"folder": "other"})
    assert store._read_record(spark, folder) == {"folder": "v2"}


def test_old_versions_are_removed(spark, make_tables, tmp_path):
    folder = tmp_path / "layout"
    for k in range(4):
        _layout(spark, make_tables, str(folder), f"v{k}", keep=1)
        versions = [p.name for p in folder.iterdir() if not p.name.startswith("_")]
        assert len(versions) == min(k + 1, 2)
        assert store.open_stored(spark, str(folder)).patient_profile.first()["last"] == f"v{k}"


def test_fingerprint_asks_the_driver_for_no_file(spark, tmp_path, monkeypatch):
    import os

    from pyspark.sql import DataFrame

    folder = str(tmp_path / "many")
    spark.range(400).repartition(200).write.parquet(folder)
    monkeypatch.setattr(DataFrame, "inputFiles", lambda self: 1 / 0)
    first = store.files_digest(spark, [folder])
    assert first == store.files_digest(spark, [folder]) and int(first.split()[0]) == sum(p.suffix == ".parquet" for p in (tmp_path / "many").iterdir()) > 100
    some = next(p for p in (tmp_path / "many").iterdir() if p.suffix == ".parquet")
    os.utime(some, (1, 1))
    assert store.files_digest(spark, [folder]) != first
    assert store._source_paths(spark.read.parquet(folder)) and store._source_paths(spark.range(3)) is None
