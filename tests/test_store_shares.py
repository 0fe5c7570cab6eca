"""Tables and sums written share by share: no row lost or doubled, shuffle
files gone after each write, nothing committed before the last share."""

from __future__ import annotations

import os
import time

import pytest
from conftest import SMOKE_DIR, rows
from pyspark.sql import functions as F

from clinicledger.operators import closing, skew
from clinicledger.sources import store
from clinicledger.sources.fixture import fixture_tables


def _shuffle_files(spark) -> set[str]:
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def _assert_no_new_shuffle_files(spark, before):
    for _ in range(100):  # Spark removes them in the background
        if not (left := _shuffle_files(spark) - before):
            return
        time.sleep(0.1)
    assert not left


@pytest.fixture()
def in_shares(monkeypatch):
    monkeypatch.setattr(store, "SHARED_BYTES", 0)
    monkeypatch.setattr(store, "NO_ESTIMATE", 1 << 200)


def test_literal_rows_are_written_at_once(make_tables):
    assert store.shares_of(make_tables(batch=[(1,)]), "batch") == 1


def test_shares_of_derived_and_plain_tables_are_the_whole(spark, make_tables):
    mapped = fixture_tables(spark, SMOKE_DIR)
    assert len(mapped._shares) == 9
    for name in ("transaction_distributions", "transactions"):
        parts = [rows(mapped.share(name, "no column", k, 3)) for k in range(3)]
        assert min(map(len, parts)) > 0 and sorted(sum(parts, []), key=str) == sorted(rows(mapped.table(name)), key=str)
    plain = make_tables(batch=[(k if k % 3 else None,) for k in range(20)] * 2)
    assert sorted(map(str, (r[0] for k in range(4) for r in plain.share("batch", "batch_id", k, 4).collect()))) == sorted(
        str(r[0]) for r in plain.batch.collect())


@pytest.mark.parametrize(("name", "buckets"), [("transaction_distributions", 8), ("patient_visit", 3), ("payment_method", 8)])
def test_a_table_in_shares_has_every_row_and_leaves_no_shuffle_files(spark, in_shares, tmp_path, name, buckets):
    mapped = fixture_tables(spark, SMOKE_DIR)
    before, path = _shuffle_files(spark), tmp_path / name
    store._write(mapped, name, str(path), f"shares_{name}", buckets, {})
    _assert_no_new_shuffle_files(spark, before)
    assert (path / "_SUCCESS").exists() and rows(spark.read.parquet(str(path))) == rows(mapped.table(name))
    if name in store.BUCKETS:
        assert rows(spark.table(f"shares_{name}")) == rows(mapped.table(name))
    if buckets == 8:  # a bucket's rows of a share are in one file
        assert len(list(path.glob("part-*.parquet"))) <= 8 * store.SHARES


def test_write_tasks_keep_buckets_whole_and_cores_busy(spark):
    cores = spark.sparkContext.defaultParallelism
    for buckets in (1, 3, 8 * cores, 8 * cores + 1, 6 * cores, 2 * cores):
        tasks = store._write_tasks(spark, buckets, 4)
        assert buckets % tasks == 0 and buckets // 4 <= tasks and tasks >= min(buckets, 2 * cores)
    assert store._write_tasks(spark, 8 * cores, 4) == 2 * cores


def test_a_stop_between_shares_commits_nothing(spark, make_tables, in_shares, tmp_path, monkeypatch):
    t = make_tables(transactions=[(k % 40 or None, k, "P", None) for k in range(200)])
    path, written = tmp_path / "transactions", []

    def until(*given, write=store._write_share):
        if len(written) == 2:
            raise InterruptedError
        written.append(given)
        write(*given)

    with monkeypatch.context() as m:
        m.setattr(store, "_write_share", until)
        with pytest.raises(InterruptedError):
            store._write(t, "transactions", str(path), "stopped_transactions", 4, {})
    assert written and list(path.glob("part-*.parquet")) and not (path / "_SUCCESS").exists()
    store._write(t, "transactions", str(path), "stopped_transactions", 4, {})
    assert (path / "_SUCCESS").exists() and rows(spark.table("stopped_transactions")) == rows(t.transactions)


def test_heavy_values_in_parts_are_those_of_the_whole(spark):
    values = [None] * 500 + [1] * 300 + [2] * 120 + list(range(10, 400))
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(zip(values, reversed(values)))], "k bigint, j bigint, i int")
    parts = [df.filter(F.col("i") % 3 == r) for r in range(3)]
    for least, want in ((50, [1, 2]), (200, [1]), (301, [])):
        assert skew.heavy_values(parts, ["k", "j"], 8, least) == {"k": want, "j": want}


def test_sums_in_shares_are_the_sums_and_leave_no_shuffle_files(spark, fixture_tables_small, tmp_path, monkeypatch):
    t = fixture_tables_small
    whole = closing.write_close_sums(t, str(tmp_path / "whole"))
    monkeypatch.setattr(store, "SHARED_BYTES", 0)
    before, seen, path = _shuffle_files(spark), [], str(tmp_path / "shares")

    def noted(t, k, n, made=closing.both_grains):
        seen.append((k, n, os.path.exists(f"{path}/_SUCCESS")))
        return made(t, k, n)

    monkeypatch.setattr(closing, "both_grains", noted)
    sums = closing.write_close_sums(t, path)
    _assert_no_new_shuffle_files(spark, before)
    assert seen == [(k, store.SHARES, False) for k in range(store.SHARES)]
    for grain in ("days", "months"):
        got = rows(getattr(sums, grain))
        assert got == rows(getattr(whole, grain)) and got
