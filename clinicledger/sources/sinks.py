"""Report sinks.

A report is written in its own order: rows are dealt by ranges of the
partition columns and the report's sort keys, and sorted within, so the files
of one month, by name, read back in report order, while many tasks write.
Sort keys that the report doesn't show come as ``SORT_PREFIX`` columns and
are dropped before the write. ``orderBy`` on the returned DataFrame (the
reports' ``ordered=True``) remains for a single ordered result set.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinicledger.functions.dates import ts_lit


#: prefix of columns that only order a report
SORT_PREFIX = "_sort_"


def with_report_date(df: DataFrame, as_of: dt.datetime, name: str = "report_date") -> DataFrame:
    """Stamp rows with the run's as-of time (a parameter, so reruns repeat)."""
    return df.withColumn(name, ts_lit(as_of))


def write_report(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = ("month_of_service",),
    sort_by: Sequence[str] = (),
    mode: str = "overwrite",
    fmt: str = "parquet",
    max_records_per_file: int = 5_000_000,
    keep_sort_keys: bool = False,
) -> None:
    """Write a report under ``path``, one directory per ``partition_by``
    value, in the order of its ``SORT_PREFIX`` columns, or of ``sort_by``
    where it has none. A month's rows lie in few files (ranges, not one file
    per task and month) of at most ``max_records_per_file`` rows.
    ``keep_sort_keys`` writes the sort columns too, for ``report_manifest``."""
    parts = [c for c in partition_by if c in df.columns]
    hidden = [c for c in df.columns if c.startswith(SORT_PREFIX)]
    keys = [*parts, *(hidden or sort_by)]
    out = df
    if keys:
        out = out.repartitionByRange(*keys).sortWithinPartitions(*keys)
    if not keep_sort_keys:
        out = out.drop(*hidden)
    writer = out.write.mode(mode).format(fmt).option("maxRecordsPerFile", max_records_per_file)
    if parts:
        writer = writer.partitionBy(*parts)
    writer.save(path)


def read_report(spark, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def _numbered(spark, path: str) -> DataFrame:
    """The rows of a written report with their file, its place by task and
    part number (names alone don't order more than 100,000 tasks), and their
    place in it."""
    name = F.col("_metadata.file_name")
    place = F.struct(*[
        F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("bigint"), F.lit(0).cast("bigint")).alias(part)
        for part, pattern in (("task", r"^part-(\d+)"), ("part", r"\.c(\d+)\."))
    ])
    return read_report(spark, path).select(
        "*", name.alias("file_name"), place.alias("file_place"), F.col("_metadata.row_index").alias("file_row")
    )


def report_manifest(
    spark, path: str, keys: Sequence[str], partition_by: Sequence[str] = ("month_of_service",)
) -> DataFrame:
    """One row per written Parquet file: its partition, name and place, rows,
    the position of its first row in the partition (from 1), its smallest and
    greatest ``keys`` as structs (nulls first), and ``ascends``: whether its
    keys start at or after those of the file before. Counted per file where
    it is read; only the manifest rows are gathered per partition."""
    parts = list(partition_by)
    key = F.struct(*keys)
    files = _numbered(spark, path).groupBy(*parts, "file_name", "file_place").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("low"), F.max(key).alias("high")
    )
    before = Window.partitionBy(*parts).orderBy("file_place", "file_name")
    return files.select(
        "*",
        (F.coalesce(F.sum("n_rows").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).alias("first_position"),
        F.coalesce(F.lag("high").over(before) <= F.col("low"), F.lit(True)).alias("ascends"),
    )


def report_positions(
    spark, path: str, keys: Sequence[str], partition_by: Sequence[str] = ("month_of_service",)
) -> DataFrame:
    """The written report's rows with ``position`` in their partition as its
    files read (by manifest place and row), and their file's ``ascends``."""
    parts = list(partition_by)
    files = report_manifest(spark, path, keys, parts).drop("file_place", "n_rows", "low", "high")
    return (
        _numbered(spark, path).join(files, [*parts, "file_name"])
        .withColumn("position", F.col("first_position") + F.col("file_row"))
        .drop("file_name", "file_place", "file_row", "first_position")
    )


def month_partition_filter(start: dt.date, end: dt.date, col: str = "month_of_service"):
    """Partition-pruning predicate on a ``yyyy-MM`` partition column for a
    date range (Spark prunes partitions by the partition column only)."""
    return (F.col(col) >= F.lit(start.strftime("%Y-%m"))) & (F.col(col) <= F.lit(end.strftime("%Y-%m")))
