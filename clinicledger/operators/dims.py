"""Dimension lookups: size-checked broadcast, left lookups, role-playing
dimensions and existence (semi) joins.

Broadcast policy: a dimension is broadcast only after a count proves it
holds at most ``max_rows`` rows. The count aggregates partially in every
task (one row per task reaches the final count), so even a wrongly labelled
large table costs one scan and no skewed shuffle; on stored Parquet it reads
no column data. A dimension over the bound is joined as is: Spark plans a
shuffle join, and AQE may still switch to a broadcast from the runtime
size. The check runs once per table per ``Tables``.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicledger.sources.tables import Tables

# Largest dimension broadcast to every task (rows). Dimensions are pruned to
# a few narrow columns before the broadcast, so this is tens of MB at most.
DIM_MAX_ROWS = 1_000_000
_LOOKUP_SEQ = itertools.count()


def rows_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows."""
    return df.count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int = DIM_MAX_ROWS) -> DataFrame:
    """``F.broadcast(df)`` when its row count is proven <= ``max_rows``."""
    return F.broadcast(df) if rows_at_most(df, max_rows) else df


def dim(t: Tables, name: str, columns: Sequence[str], max_rows: int = DIM_MAX_ROWS) -> DataFrame:
    """Columns of dimension table ``name``, broadcast when its size check
    passes (memoised on ``t``)."""
    def build():
        df = t.table(name).select(*columns)
        return F.broadcast(df) if dims_checked(t, name, max_rows=max_rows) else df

    return t.memo(("dim", name, tuple(columns), max_rows), build)


def dims_checked(t: Tables, *names: str, max_rows: int = DIM_MAX_ROWS) -> bool:
    """True when every named dimension passed its size check."""
    for name in names:
        key = (name, max_rows)
        if key not in t._checked:
            t._checked[key] = rows_at_most(t.table(name), max_rows)
    return all(t._checked[(n, max_rows)] for n in names)


def broadcast_derived(df: DataFrame, t: Tables, bound_by: str, *also: str) -> DataFrame:
    """Broadcast a table derived from dimensions when its size is bounded by
    a checked dimension: ``df`` must have at most as many rows as
    ``bound_by`` (e.g. that dimension joined to unique keys of the ``also``
    dimensions, filtered, or aggregated)."""
    return F.broadcast(df) if dims_checked(t, bound_by, *also) else df


def lookup(
    df: DataFrame,
    dimension: DataFrame,
    left_key: str,
    dim_key: str,
    columns: Mapping[str, str],
    how: str = "left",
) -> DataFrame:
    """Join ``dimension`` on ``left_key = dim_key`` and add ``columns``
    (``{dimension column: output name}``). ``how='left'`` keeps unmatched
    rows with NULLs; ``how='inner'`` drops them."""
    tag = f"_dim{next(_LOOKUP_SEQ)}"
    right = dimension.alias(tag)
    joined = df.alias("_row").join(right, F.col(f"_row.{left_key}") == F.col(f"{tag}.{dim_key}"), how)
    # rename after the join: the broadcast side stays the plain dimension, so
    # roles reading the same columns share one broadcast exchange
    return joined.select("_row.*", *[F.col(f"{tag}.{c}").alias(out) for c, out in columns.items()])


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace NULLs of unmatched lookups by defaults (``coalesce``), keeping
    each column's type."""
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in defaults.items()}
    )


def require_exists(df: DataFrame, keys: DataFrame, left_key: str, key: str | None = None) -> DataFrame:
    """Keep rows whose ``left_key`` occurs in ``keys`` (an inner join that
    reads no column of the other side; a semi join never multiplies rows)."""
    key = key or left_key
    right = keys.select(F.col(key).alias("_exists_key"))
    return df.join(right, F.col(left_key) == F.col("_exists_key"), "left_semi")


# --- role-playing dimensions -------------------------------------------------

def with_providers(df: DataFrame, t: Tables, roles: Mapping[str, str], how: str = "inner") -> DataFrame:
    """DoctorFacility in several roles: ``{id column: name column}``, e.g.
    ``{"doctor_id": "doctor_name", "facility_id": "facility_name"}``. Each
    role is a broadcast lookup of the same size-checked dimension."""
    providers = dim(t, "doctor_facility", ["doctor_facility_id", "list_name"])
    for id_col, name_col in roles.items():
        df = lookup(df, providers, id_col, "doctor_facility_id", {"list_name": name_col}, how)
    return df


def facility_place(df: DataFrame, t: Tables, facility_col: str, out: str) -> DataFrame:
    """Place-of-service code of the facility (two lookups: facility ->
    place-of-service list id -> code; both left joins)."""
    facilities = dim(t, "doctor_facility", ["doctor_facility_id", "place_of_service_mid"])
    df = lookup(df, facilities, facility_col, "doctor_facility_id", {"place_of_service_mid": "_pos_mid"})
    return with_medlist(df, t, "_pos_mid", {"code": out}).drop("_pos_mid")


def with_medlist(df: DataFrame, t: Tables, key_col: str, columns: Mapping[str, str], how: str = "left") -> DataFrame:
    """MedLists in one of its roles (policy type, department, place of
    service, qualifier, resource type, adjustment type)."""
    med = dim(t, "med_lists", ["med_lists_id", "description", "code", "function_name"])
    return lookup(df, med, key_col, "med_lists_id", columns, how)


# --- composite dimensions (a dimension with its own lookup pre-joined) -------

def facility_places(t: Tables) -> DataFrame:
    """``(doctor_facility_id, list_name, pos_code)``: every DoctorFacility
    row with its place-of-service code (left lookup on the unique MedLists
    id, so at most one row per facility). One probe per row instead of two
    chained lookups; broadcast under DoctorFacility's bound."""

    def build():
        f = t.doctor_facility.select("doctor_facility_id", "list_name", "place_of_service_mid")
        out = lookup(f, dim(t, "med_lists", ["med_lists_id", "code"]), "place_of_service_mid", "med_lists_id",
                     {"code": "pos_code"}).drop("place_of_service_mid")
        return broadcast_derived(out, t, "doctor_facility", "med_lists")

    return t.memo(("facility_places",), build)


def carrier_policies(t: Tables) -> DataFrame:
    """``(insurance_carriers_id, list_name, policy_type_mid, policy_type)``:
    every carrier with its policy-type description (left lookup)."""

    def build():
        c = t.insurance_carriers.select("insurance_carriers_id", "list_name", "policy_type_mid")
        out = lookup(c, dim(t, "med_lists", ["med_lists_id", "description"]), "policy_type_mid", "med_lists_id",
                     {"description": "policy_type"})
        return broadcast_derived(out, t, "insurance_carriers", "med_lists")

    return t.memo(("carrier_policies",), build)


def with_facility(df: DataFrame, t: Tables, facility_col: str, name_out: str, pos_out: str,
                  how: str = "inner") -> DataFrame:
    """Facility name and place-of-service code in one lookup."""
    return lookup(df, facility_places(t), facility_col, "doctor_facility_id",
                  {"list_name": name_out, "pos_code": pos_out}, how)


def with_carrier(df: DataFrame, t: Tables, carrier_col: str, how: str = "left",
                 names: Mapping[str, str] | None = None) -> DataFrame:
    """Carrier name, policy type id and policy type description in one
    lookup (``how='inner'`` drops visits without a known carrier)."""
    names = names or {"list_name": "insurance_carrier", "policy_type_mid": "policy_type_mid",
                      "policy_type": "policy_type"}
    return lookup(df, carrier_policies(t), carrier_col, "insurance_carriers_id", names, how)
