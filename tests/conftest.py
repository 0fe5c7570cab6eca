from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from clinicledger.session import get_spark

    session = get_spark("local[4]", shuffle_partitions=4, app_name="clinicledger-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_tables(spark):
    """Build a ``Tables`` from literal rows; unlisted tables are empty."""
    from clinicledger.sources.tables import TABLE_SCHEMAS, Tables

    def build(**rows):
        frames = {}
        for name, ddl in TABLE_SCHEMAS.items():
            frames[name] = spark.createDataFrame(rows.get(name, []), ddl)
        return Tables(**frames)

    return build


@pytest.fixture(scope="session")
def fixture_tables_small(spark):
    from clinicledger.plans.registry import tables

    return tables(spark, SMOKE_DIR)


def rows(df, *cols):
    """Sorted list of tuples of ``cols`` (all columns when none given)."""
    cols = cols or tuple(df.columns)
    return sorted((tuple(r) for r in df.select(*cols).collect()),
                  key=lambda t: tuple((v is None, "" if v is None else v) for v in t))
