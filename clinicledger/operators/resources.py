"""Visit resources: collapse-to-label aggregations and resource fan-out.

Two "(Multiple)" rules exist and mean different things:

* by visit (encounter report): more than one resource on the visit;
* by assignment (revenue journal): more than one provider-type assignment
  of one visit resource.

All aggregates here are algebraic (count, max), so a visit with a huge
number of rows is combined map-side before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicledger.constants import EXCLUDED_RESOURCE_SUBTYPES, MULTIPLE_LABEL, PROVIDER_TYPES
from clinicledger.operators.dims import broadcast_derived, dim, require_exists
from clinicledger.operators.filters import drop_values, keep_values
from clinicledger.operators.skew import by_parts
from clinicledger.sources.tables import Tables


def _per_visit(t: Tables, columns: Sequence[str], within: DataFrame | None, use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``use`` of the visit resources, restricted to the visits in ``within``
    (a semi join read in place on the visit bucketing) when given; visits
    stored apart go by themselves."""
    def part(pvr: DataFrame) -> DataFrame:
        pvr = pvr.select(*columns)
        return use(pvr if within is None else require_exists(pvr, within, "patient_visit_id"))

    return by_parts(t, "patient_visit_resource", part)


def _label(name_col: str) -> F.Column:
    return F.when(F.count(F.lit(1)) > 1, F.lit(MULTIPLE_LABEL)).otherwise(F.max(name_col))


def resource_label_by_visit(t: Tables, within: DataFrame | None = None) -> DataFrame:
    """``(patient_visit_id, resource_label)``: the resource's name, or
    '(Multiple)' when the visit has more than one resource. ``within``
    restricts the work to those visits."""
    if within is not None:
        return _label_by_visit(t, within)
    return t.memo(("resource_label_by_visit",), lambda: _label_by_visit(t, None))


def _label_by_visit(t: Tables, within: DataFrame | None) -> DataFrame:
    names = dim(t, "doctor_facility", ["doctor_facility_id", "list_name"])
    return _per_visit(t, ["patient_visit_id", "resource_id"], within, lambda pvr: (
        pvr.join(names, pvr.resource_id == names.doctor_facility_id)
        .groupBy("patient_visit_id")
        .agg(_label("list_name").alias("resource_label"))
    ))


def resource_label_by_assignment(t: Tables, provider_types: Sequence[str] = PROVIDER_TYPES,
                                 within: DataFrame | None = None) -> DataFrame:
    """``(patient_visit_id, patient_visit_resource_id, dot_id, resource_name,
    resource_type)`` per visit resource restricted to provider types:
    '(Multiple)' when the resource has more than one such type assignment,
    and the greatest type name. Visit resource ids are unique (T22)."""
    if within is not None:
        return _label_by_assignment(t, provider_types, within)
    return t.memo(("resource_label_by_assignment", tuple(provider_types)),
                  lambda: _label_by_assignment(t, provider_types, None))


def _label_by_assignment(t: Tables, provider_types: Sequence[str], within: DataFrame | None) -> DataFrame:
    # a visit resource names one resource, so its group of assignments is the
    # resource's: it is summed up in the dimension, and visit resources are
    # only looked up
    names = dim(t, "doctor_facility", ["doctor_facility_id", "list_name", "dot_id"])
    kinds = provider_type_assignments(t, provider_types).groupBy("resource_id").agg(
        F.count(F.lit(1)).alias("n_kinds"), F.max("type_name").alias("resource_type")
    )
    kinds = broadcast_derived(kinds, t, "resource_type_assignments", "med_lists")
    label = F.when(F.col("n_kinds") > 1, F.lit(MULTIPLE_LABEL)).otherwise(F.col("list_name"))
    return _per_visit(t, ["patient_visit_id", "patient_visit_resource_id", "resource_id"], within, lambda pvr: (
        pvr.join(names, pvr.resource_id == names.doctor_facility_id)
        .join(kinds, "resource_id")
        .select("patient_visit_id", "patient_visit_resource_id", "dot_id", label.alias("resource_name"), "resource_type")
    ))


def provider_type_assignments(t: Tables, provider_types: Sequence[str] = PROVIDER_TYPES) -> DataFrame:
    """``(resource_id, resource_type_id, type_name)`` of provider-type
    assignments. Both inputs are dimensions and type ids are unique, so the
    result has at most as many rows as the assignments and is broadcast to
    the (large) visit-resource side: a doctor with a huge number of visits is
    never a hot shuffle key."""
    rta = dim(t, "resource_type_assignments", ["resource_id", "resource_type_id"])
    types = keep_values(dim(t, "med_lists", ["med_lists_id", "description"]), "description", provider_types)
    out = rta.join(types, rta.resource_type_id == types.med_lists_id).select(
        "resource_id", "resource_type_id", F.col("description").alias("type_name")
    )
    return broadcast_derived(out, t, "resource_type_assignments", "med_lists")


def visit_resource_types(t: Tables, provider_types: Sequence[str] = PROVIDER_TYPES,
                         within: DataFrame | None = None) -> DataFrame:
    """``(patient_visit_id, resource_id, resource_type)``: one row per visit
    resource and provider-type assignment (the fan-out of the encounter
    rollup; duplicates are kept on purpose)."""
    if within is not None:
        return _visit_resource_types(t, provider_types, within)
    return t.memo(("visit_resource_types", tuple(provider_types)),
                  lambda: _visit_resource_types(t, provider_types, None))


def _visit_resource_types(t: Tables, provider_types: Sequence[str], within: DataFrame | None) -> DataFrame:
    types = provider_type_assignments(t, provider_types)
    return _per_visit(t, ["patient_visit_id", "resource_id"], within, lambda pvr: pvr.join(types, "resource_id").select(
        "patient_visit_id", "resource_id", F.col("type_name").alias("resource_type")
    ))


def resource_fanout(t: Tables, excluded_subtypes: Sequence[int] = EXCLUDED_RESOURCE_SUBTYPES,
                    within: DataFrame | None = None) -> DataFrame:
    """``(patient_visit_id, fanout)``: number of (visit resource x type
    assignment) rows of a visit whose type exists and is not excluded.
    Collections sum each payment once per such row."""
    if within is not None:
        return _resource_fanout(t, excluded_subtypes, within)
    return t.memo(("resource_fanout", tuple(excluded_subtypes)),
                  lambda: _resource_fanout(t, excluded_subtypes, None))


def _counted_types(t: Tables, excluded_subtypes: Sequence[int]) -> DataFrame:
    """``(resource_id, n_types)``: counted type assignments per resource, broadcast."""
    rta = drop_values(dim(t, "resource_type_assignments", ["resource_id", "resource_type_id"]),
                      "resource_type_id", excluded_subtypes)
    types = dim(t, "med_lists", ["med_lists_id"])
    assignments = rta.join(types, rta.resource_type_id == types.med_lists_id).groupBy("resource_id").agg(
        F.count(F.lit(1)).alias("n_types")
    )
    return broadcast_derived(assignments, t, "resource_type_assignments", "med_lists")


def visit_resource_profile(t: Tables, excluded_subtypes: Sequence[int] = EXCLUDED_RESOURCE_SUBTYPES,
                           within: DataFrame | None = None) -> DataFrame:
    """``(patient_visit_id, fanout, resource_copies)``: ``resource_fanout``
    (NULL without a counted assignment) and the number of visit resources, in
    one aggregate."""
    assignments = _counted_types(t, excluded_subtypes)
    return _per_visit(t, ["patient_visit_id", "resource_id"], within, lambda pvr: (
        pvr.join(assignments, "resource_id", "left")
        .groupBy("patient_visit_id")
        .agg(F.sum("n_types").cast("bigint").alias("fanout"), F.count(F.lit(1)).alias("resource_copies"))
    ))


def _resource_fanout(t: Tables, excluded_subtypes: Sequence[int], within: DataFrame | None) -> DataFrame:
    assignments = _counted_types(t, excluded_subtypes)
    return _per_visit(t, ["patient_visit_id", "resource_id"], within, lambda pvr: (
        pvr.join(assignments, "resource_id")
        .groupBy("patient_visit_id")
        .agg(F.sum("n_types").cast("bigint").alias("fanout"))
    ))


def expand_resources(df: DataFrame, t: Tables, provider_types: Sequence[str] = PROVIDER_TYPES) -> DataFrame:
    """Repeat each row of ``df`` once per (resource, provider type) of its
    visit, adding ``resource_id`` and ``resource_type``; visits without any
    drop out (inner join)."""
    return df.join(visit_resource_types(t, provider_types), "patient_visit_id")
