"""The stored layout: re-storing with another bucket count or changed data,
rejected and interrupted versions, bucket sizing."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from clinicledger.__main__ import main
from clinicledger.sources import store
from clinicledger.sources.tables import Tables, load_tables


@pytest.fixture(scope="module")
def plain(spark, fixture_tables_small, tmp_path_factory):
    """The small tables as plain Parquet, one folder per table."""
    src = str(tmp_path_factory.mktemp("plain"))
    for name in Tables.names():
        fixture_tables_small.table(name).write.parquet(f"{src}/{name}")
    return src


def lines_with_amounts(t: Tables):
    joined = t.patient_visit_procs.join(t.patient_visit_procs_agg, "patient_visit_procs_id")
    return joined.agg(F.count("*"), F.sum("ins_allocation")).first()


def test_another_bucket_count_keeps_every_row(spark, plain, tmp_path):
    target = str(tmp_path / "layout")
    source = load_tables(spark, plain)
    first = lines_with_amounts(store.store_tables(source, target, buckets=4))
    for buckets in (16, 4):
        again = store.store_tables(source, target, buckets=buckets)
        assert lines_with_amounts(again) == first == lines_with_amounts(source)
        assert lines_with_amounts(store.open_stored(spark, target)) == first


def test_changed_source_is_stored_anew(spark, plain, tmp_path):
    src, target = str(tmp_path / "src"), str(tmp_path / "layout")
    for name in Tables.names():
        spark.read.parquet(f"{plain}/{name}").write.parquet(f"{src}/{name}")
    before = store.store_tables(load_tables(spark, src), target, buckets=4).patient_visit.count()
    spark.read.parquet(f"{plain}/patient_visit").limit(10).write.mode("overwrite").parquet(f"{src}/patient_visit")
    assert before > 10
    assert store.store_tables(load_tables(spark, src), target, buckets=4).patient_visit.count() == 10
    assert store.open_stored(spark, target).patient_visit.count() == 10


def test_rejected_version_is_never_opened(spark, plain, tmp_path):
    src, target = str(tmp_path / "src"), str(tmp_path / "layout")
    for name in Tables.names():
        spark.read.parquet(f"{plain}/{name}").write.parquet(f"{src}/{name}")
    good = store.store_tables(load_tables(spark, src), target, buckets=4, check_keys=True).patient_visit.count()
    twice = spark.read.parquet(f"{plain}/patient_visit")
    twice.unionByName(twice.limit(1)).write.mode("overwrite").parquet(f"{src}/patient_visit")
    for _ in range(2):
        with pytest.raises(ValueError, match="patient_visit"):
            main(["store", "--source", src, "--target", target, "--buckets", "4"])
    assert store.open_stored(spark, target).patient_visit.count() == good
    fresh = str(tmp_path / "fresh")
    with pytest.raises(ValueError, match="patient_visit"):
        main(["store", "--source", src, "--target", fresh, "--buckets", "4"])
    assert not store.is_stored(spark, fresh)


def test_literal_rows_are_never_taken_for_a_copy(spark, make_tables, tmp_path):
    target = str(tmp_path / "layout")
    row = {"patient_profile": [(1, "p1", "last")]}
    assert store.store_tables(make_tables(**row), target, buckets=2).patient_profile.count() == 1
    assert store.store_tables(make_tables(), target, buckets=2).patient_profile.count() == 0


def test_bucket_count_follows_the_data(spark):
    cores = spark.sparkContext.defaultParallelism
    small = store.default_buckets(spark)
    assert small >= 2 * cores and small & (small - 1) == 0
    large = store.default_buckets(spark, 100 << 40)
    assert large & (large - 1) == 0 and (100 << 40) / large <= store.BUCKET_BYTES
    assert store.default_buckets(spark, 10 * store.BUCKET_BYTES * small) >= 10 * small


def test_checkpoint_folder_must_be_named_off_local_masters():
    from types import SimpleNamespace

    from clinicledger.session import ensure_checkpoint_dir

    context = SimpleNamespace(
        getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=None
    )
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=context))


def test_lists_behave_alike_at_every_length(spark):
    import datetime as dt
    from decimal import Decimal

    from clinicledger.operators import filters

    df = spark.createDataFrame(
        [(1, "a\\b", dt.date(2020, 1, 1), Decimal("1.50")), (2, "it's", dt.date(2020, 1, 2), Decimal("2.50")),
         (3, None, None, None), (4, "", dt.date(2020, 1, 3), Decimal("0.00"))], "id int, s string, d date, m decimal(9,2)",
    )
    cases = [("s", ["a\\b", "it's", None, ""], [f"x{k}" for k in range(6000)]), ("id", [1, 2, 4, None], list(range(100, 6100))),
             ("d", [dt.date(2020, 1, k) for k in (1, 2, 3)], [dt.date(1980, 1, 1) + dt.timedelta(days=k) for k in range(6000)]),
             ("m", [Decimal("1.50"), Decimal("2.5"), Decimal("0")], [Decimal(k) for k in range(100, 6100)])]
    for col, wanted, filler in cases:
        for n in (0, filters.INLINE_LIST_MAX - len(wanted), filters.INLINE_LIST_MAX - len(wanted) + 1, len(filler)):
            values = [*wanted, *filler[:n]]
            assert rows(filters.optional_in(df, col, values), "id") == [(1,), (2,), (4,)], (col, n)
            assert rows(filters.exclude_keys(df, col, values), "id") == ([(3,)] if col == "id" else []), (col, n)
            assert rows(filters.exclude_keys(df, col, [wanted[0], *filler[:n]]), "id") == (
                [(2,), (3,), (4,)] if col == "id" else [(2,), (4,)]
            )
    empty = spark.createDataFrame([], "k string")
    assert rows(filters.exclude_keys(df, "s", []), "id") == rows(filters.exclude_keys(df, "s", empty), "id") == [(1,), (2,), (4,)]
    assert filters.optional_in(df, "s", []).count() == filters.optional_in(df, "s", [None]).count() == 0


def test_bounded_window_is_never_true_with_an_unset_bound(spark):
    import datetime as dt

    from clinicledger.functions.dates import in_window

    df = spark.createDataFrame([(dt.datetime(1997, 1, 1),)], "t timestamp_ntz")
    a, b = dt.datetime(1996, 1, 1), dt.datetime(1998, 1, 1)
    assert [df.filter(in_window("t", x, y, "bounded")).count() for x, y in ((a, b), (None, b), (a, None), (None, None))] == [1, 0, 0, 0]


def test_journal_without_a_bound_has_no_collections(spark, fixture_tables_small):
    import dataclasses

    from clinicledger.plans import reports
    from clinicledger.plans.registry import REVENUE

    for unset in ("start", "end"):
        p = dataclasses.replace(REVENUE, **{unset: None})
        journal = reports.revenue_journal(fixture_tables_small, p)
        assert journal.count() > 0 and journal.filter("payments_to_date is not null").count() == 0


def test_written_reports_read_back_in_report_order(spark, fixture_tables_small, tmp_path):
    import dataclasses
    import glob

    import pyarrow.parquet as pq

    from clinicledger.plans import reports
    from clinicledger.plans.registry import ENCOUNTER, REVENUE
    from clinicledger.sources import sinks

    t = fixture_tables_small
    for k, (report, p) in enumerate(((reports.encounter_report, ENCOUNTER), (reports.revenue_journal, REVENUE))):
        out = str(tmp_path / f"report{k}")
        sinks.write_report(report(t, dataclasses.replace(p, ordered=False), sort_keys=True), out, max_records_per_file=50)
        ordered = report(t, dataclasses.replace(p, ordered=True))
        months = sorted(r[0] for r in ordered.select("month_of_service").distinct().collect())
        columns = [c for c in ordered.columns if c != "month_of_service"]
        for month in months[:2]:
            files = sorted(glob.glob(f"{out}/month_of_service={month}/*.parquet"))
            back = [tuple(r[c] for c in columns) for f in files for r in pq.ParquetFile(f).read().to_pylist()]
            want = [tuple(r[c] for c in columns) for r in ordered.filter(F.col("month_of_service") == month).collect()]
            assert sorted(map(repr, back)) == sorted(map(repr, want))
            key = ("date_of_service",) if k else ("facility_name", "ticket_number")
            at = [columns.index(c) for c in key if c in columns]
            if k:
                assert [tuple(r[i] for i in at) for r in back] == [tuple(r[i] for i in at) for r in want]
    out = str(tmp_path / "visits")
    sinks.write_report(reports.visit_payments(t, "48"), out, partition_by=(), sort_by=("visit",))
    assert not glob.glob(f"{out}/*=*") and spark.read.parquet(out).count() == reports.visit_payments(t, "48").count()
