"""A derived copy stores the tables a query reads and no others."""

from __future__ import annotations

import shutil
from decimal import Decimal

import pytest
from conftest import SMOKE_DIR, rows

import __spark_entry__ as entry
from clinicledger.operators import skew
from clinicledger.plans import registry
from clinicledger.sources import store
from clinicledger.sources.fixture import fixture_tables


def _versions(folder) -> list:
    return [p for p in folder.iterdir() if not p.name.startswith("_")]


def _stored(folder) -> set[str]:
    return {p.name for v in _versions(folder) for p in v.iterdir() if (p / "_SUCCESS").exists()}


def test_a_query_stores_what_it_reads(spark, tmp_path):
    shutil.copytree(SMOKE_DIR, src := tmp_path / "src")
    found = entry.queries()["optional_in_unset"](spark, str(src))
    t = registry.tables(spark, str(src))
    assert repr(t) == "TablesOnUse(patient_visit)"
    assert found.count() == spark.read.parquet(f"{SMOKE_DIR}/orders.parquet").count() > 0
    assert entry.queries()["batch_exists"](spark, str(src)).count() > 0
    assert set(repr(t)[12:-1].split(", ")) == {"patient_visit", "patient_visit_procs", "batch"}


def test_tables_and_heavy_keys_are_stored_on_use_once(spark, make_tables, tmp_path):
    t = make_tables(
        transaction_distributions=[dict(transactions_id=k, patient_visit_procs_id=1 if k % 2 else k, amount=Decimal(k)) for k in range(80)],
        transactions=[(k, k, "P", None) for k in range(80)],
    )
    copy, folder = store.store_on_use(t, str(tmp_path / "copy"), 4, least_heavy=20), tmp_path / "copy"
    assert _versions(folder) == [] and not store.is_stored(spark, str(folder))
    assert rows(copy.transactions) == rows(t.transactions) and _stored(folder) == {"transactions"}
    (version,) = _versions(folder)
    assert not (version / "_heavy.json").exists()
    light, apart = copy.parts("transaction_distributions")
    assert copy.heavy == {skew.LINE: [1]} and apart.count() == light.count() == 40
    assert rows(copy.transaction_distributions) == rows(t.transaction_distributions)
    assert copy.transactions is copy.transactions and _stored(folder) == {"transactions", "transaction_distributions"}
    with pytest.raises(FileNotFoundError):
        store.open_stored(spark, str(folder))
    assert not hasattr(copy, "no_such_table")


def test_changed_files_are_not_mixed_with_earlier_ones(spark, tmp_path):
    shutil.copytree(SMOKE_DIR, src := tmp_path / "src")
    copy = store.store_on_use(fixture_tables(spark, str(src)), str(tmp_path / "copy"), 4)
    assert copy.batch.count() > 0
    spark.read.parquet(f"{SMOKE_DIR}/region.parquet").limit(2).write.parquet(str(tmp_path / "other"))
    shutil.copy(next((tmp_path / "other").glob("part-*.parquet")), src / "region.parquet")
    with pytest.raises(RuntimeError, match="changed"):
        copy.procedures  # noqa: B018
    assert copy.batch.count() > 0 and _stored(tmp_path / "copy") == {"batch"}


def test_old_versions_stored_on_use_are_removed(spark, make_tables, tmp_path):
    for k in range(3):
        copy = store.store_on_use(make_tables(batch=[(k,)]), str(tmp_path / "copy"), 2, keep=1)
        assert rows(copy.batch) == [(k,)]
        assert len(_versions(tmp_path / "copy")) == min(k + 1, 2)
