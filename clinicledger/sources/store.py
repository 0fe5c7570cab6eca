"""Storage layout of the billing tables, and a stored copy of derived tables
in the cluster's shared checkpoint folder.

Layout ("bucket by the key a table is probed on"): every fact table is
bucketed on the key the reports join it by, all with the same bucket
count, so each join of the visit -> procedure line -> payment chain
shuffles only its small, already filtered side and reads the big table in
place:

* procedure lines, their aggregates and payment distributions by the line
  id (the window's lines meet their aggregates and distributions without
  any shuffle);
* transactions and visit transactions by their own ids (the window's
  distributions walk the chain, the tables stay put);
* visits, visit aggregates and visit resources by visit.

Bucketing is used only where the probing side cannot pile up on one key
(line, transaction and visit ids are near-unique there). Payment methods
and patient profiles are *not* bucketed: one check can cover a large share
of all visit transactions, and one (pseudo-)patient a large share of all
visits. Joined as shuffle joins on both sides, such a hot key is split by
AQE's skew join, which needs a shuffle on both sides and cannot split a
bucket read in place.

Rows under a key that refers more rows than a bucket should hold are stored
apart, in plain files (``operators.skew``).

Tables the reports filter by date are sorted on that date (within each
bucket, or range-partitioned on date then key), so Parquet min/max
statistics skip row groups outside the window. Bucketed tables are
registered in the session catalog over their files (re-registered from the
files in a new session); the rest are plain Parquet.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinicledger.operators.skew import LEAST_ROWS, SPLIT_TABLES, heavy_summary
from clinicledger.session import UNMARKED, ensure_checkpoint_dir, mark_complete, shuffles_freed
from clinicledger.session import path_exists as _path_exists
from clinicledger.sources.tables import TABLE_SCHEMAS, Tables, assert_unique_keys

#: part of every version's name; raise it when the layout itself changes
LAYOUT_VERSION = 7
# table -> (bucket key, sort columns within a bucket)
BUCKETS: dict[str, tuple[str, tuple[str, ...]]] = {
    "patient_visit_procs": ("patient_visit_procs_id", ("date_of_service_from",)),
    "patient_visit_procs_agg": ("patient_visit_procs_id", ("patient_visit_procs_id",)),
    "transaction_distributions": ("patient_visit_procs_id", ("patient_visit_procs_id",)),
    "transactions": ("transactions_id", ()),
    "visit_transactions": ("visit_transactions_id", ()),
    "patient_visit": ("patient_visit_id", ()),
    "patient_visit_agg": ("patient_visit_id", ()),
    "patient_visit_resource": ("patient_visit_id", ()),
}
# unbucketed tables written in date order: range-partitioned on the date,
# then the key (equal dates still split over partitions), sorted within
SORTED: dict[str, tuple[str, ...]] = {
    "payment_method": ("date_of_entry", "payment_method_id"),
}


#: bytes of a table (as the optimizer estimates them) per bucket
BUCKET_BYTES = 256 << 20


def default_buckets(spark: SparkSession, table_bytes: int = 0) -> int:
    """Bucket count of a layout: two tasks per core, at least one bucket for
    every ``BUCKET_BYTES`` of its largest table and no fewer than a shuffle's
    partitions, as a power of two. All tables share the count, so that every
    join meets in place; of two sides Spark keeps the one with more partitions,
    so with fewer buckets a table would be shuffled to meet a few rows."""
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = max(2 * spark.sparkContext.defaultParallelism, -(-table_bytes // BUCKET_BYTES), shuffled)
    return 1 << (least - 1).bit_length()


def largest_table_bytes(tables: Tables) -> int:
    """Estimated size of the largest bucketed table (plan statistics only)."""
    return max(estimated_bytes(tables.table(name)) for name in BUCKETS)


#: shares a table is written in, one after the other, so that only one share's
#: rows lie in shuffle files; tables below so many bytes are written at once
SHARES = 4
SHARED_BYTES = 16 << 20
#: estimates from here on are those of plans without statistics
NO_ESTIMATE = 1 << 50


def estimated_bytes(df: DataFrame) -> int:
    """Size of ``df`` by plan statistics only."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shares_of(tables: Tables, name: str) -> int:
    """Number of shares table ``name`` is read and written in; one if its size
    isn't known (literal rows)."""
    return SHARES if SHARED_BYTES <= estimated_bytes(tables.table(name)) < NO_ESTIMATE else 1


def _source_paths(df: DataFrame) -> list[str] | None:
    """Root paths of the file relations that ``df`` is read from; None if a
    part of it comes from elsewhere. Nothing is listed."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    paths: set[str] = set()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() != "LogicalRelation" or not hasattr(leaf.relation(), "location"):
            return None
        roots = leaf.relation().location().rootPaths()
        paths.update(roots.apply(i).toString() for i in range(roots.size()))
    return sorted(paths) or None


def files_digest(spark: SparkSession, paths: list[str]) -> str:
    """Digest of all files under ``paths``, whatever their order: the engine
    lists them (in parallel for many folders), a task hashes each file's
    path, length and time, and the sums over these come to the driver. No
    file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    line = F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    parts = [F.conv(F.substring(F.sha2(line, 256), at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16)]
    found = files.select(*[p.alias(f"h{k}") for k, p in enumerate(parts)], "length").agg(
        F.count(F.lit(1)), F.sum("length"), F.sum("h0"), F.sum("h1")
    ).first()
    return " ".join(str(v) for v in found)


def source_fingerprint(tables: Tables) -> str:
    """Digest of what the tables are read from: each table's plan and the
    files under the paths it reads. Tables without files (literal rows) get a
    new digest each time, so they are never mistaken for a copy."""
    digest = hashlib.sha256()
    every: set[str] = set()
    for name in Tables.names():
        df = tables.table(name)
        paths = _source_paths(df)
        if paths is None:
            return uuid.uuid4().hex
        plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
        digest.update(f"{name} {df.schema.simpleString()} {re.sub('#[0-9]+L?', '', plan)} {paths}".encode())
        every.update(paths)
    digest.update(files_digest(tables.spark, sorted(every)).encode())
    return digest.hexdigest()


def _files_state(tables: Tables) -> str:
    """Digest of the files that those tables are read from that have any."""
    every = {path for name in Tables.names() for path in _source_paths(tables.table(name)) or ()}
    return files_digest(tables.spark, sorted(every)) if every else ""


def _table_name(prefix: str, name: str) -> str:
    return f"{prefix}_{name}"


def _register(spark: SparkSession, table: str, name: str, path: str, buckets: int) -> None:
    """(Re)register bucketed files as a catalog table (metadata only)."""
    key, sort = BUCKETS[name]
    sorted_by = f" SORTED BY ({', '.join(sort)})" if sort else ""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(
        f"CREATE TABLE {table} ({TABLE_SCHEMAS[name]}) USING parquet "
        f"CLUSTERED BY ({key}){sorted_by} INTO {buckets} BUCKETS LOCATION '{path}'"
    )


#: options of every write; stored copies take a third less room than by default
WRITTEN = {"compression": "zstd", **UNMARKED}
#: folder of a bucketed table's rows under heavy keys, beside its own
APART = "__apart"


def _write(tables: Tables, name: str, path: str, table: str, buckets: int, heavy: dict[str, list[int]]) -> None:
    """Write table ``name`` share by share; it is committed (``_SUCCESS``) when
    all are written."""
    spark = tables.spark
    if name in BUCKETS:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    by = BUCKETS[name][0] if name in BUCKETS else tables.table(name).columns[0]
    n = shares_of(tables, name)
    for k in range(n):
        with shuffles_freed(spark):
            _write_share(tables.share(name, by, k, n), n, name, path, table, buckets, heavy, "append" if k else "overwrite")
    mark_complete(spark, path)


def _write_tasks(spark: SparkSession, buckets: int, shares: int) -> int:
    """Tasks that write a share: it is small, so a task has several buckets of
    it, as long as there are two tasks per core. A divisor of the bucket count,
    or a bucket's rows would be in several tasks."""
    least = 2 * spark.sparkContext.defaultParallelism
    several = max((d for d in range(1, shares + 1) if buckets % d == 0 and buckets // d >= least), default=1)
    return buckets // several


def _write_share(
    df: DataFrame, shares: int, name: str, path: str, table: str, buckets: int, heavy: dict[str, list[int]], mode: str
) -> None:
    if name in BUCKETS:
        key, sort = BUCKETS[name]
        apart = heavy.get(key) if SPLIT_TABLES.get(name) == key else None
        if apart:
            is_apart = F.coalesce(F.col(key).isin(apart), F.lit(False))
            # dealt round: a heavy key's rows lie in all files
            df.filter(is_apart).repartition(buckets).write.options(**WRITTEN).mode(mode).parquet(f"{path}{APART}")
            df = df.filter(~is_apart)
        # a bucket's rows are in one task, which writes one file per bucket (no
        # tasks x buckets file explosion); within the file rows are sorted for
        # skipping
        writer = df.repartition(_write_tasks(df.sparkSession, buckets, shares), key).write.options(**WRITTEN).mode(mode).format("parquet").option("path", path)
        writer = writer.bucketBy(buckets, key)
        if sort:
            writer = writer.sortBy(*sort)
        writer.saveAsTable(table)
    else:
        if name in SORTED:
            keys = SORTED[name]
            df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        df.write.options(**WRITTEN).mode(mode).parquet(path)


def save_table(tables: Tables, name: str, base_dir: str, prefix: str, buckets: int, heavy: dict[str, list[int]]) -> None:
    """Write table ``name`` under ``{base_dir}/{name}`` in the report layout.
    A table already committed (``_SUCCESS`` present) is kept, so an interrupted
    copy resumes where it stopped."""
    spark = tables.spark
    target, table = f"{base_dir}/{name}", _table_name(prefix, name)
    if not _path_exists(spark, f"{target}/_SUCCESS"):
        _write(tables, name, target, table, buckets, heavy)
    elif name in BUCKETS and not spark.catalog.tableExists(table):
        _register(spark, table, name, target, buckets)


def save_tables(tables: Tables, base_dir: str, prefix: str, buckets: int, heavy: dict[str, list[int]]) -> None:
    """``save_table`` of every table."""
    for name in Tables.names():
        save_table(tables, name, base_dir, prefix, buckets, heavy)


def _load_table(
    spark: SparkSession, name: str, base_dir: str, prefix: str, heavy: dict[str, list[int]]
) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """A stored table, and its rows in place and those stored apart, if any:
    bucketed tables through the catalog (so Spark knows their partitioning),
    the rest as Parquet with declared schemas."""
    if name not in BUCKETS:
        return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{base_dir}/{name}"), None
    frame = spark.table(_table_name(prefix, name))
    if not heavy.get(SPLIT_TABLES.get(name)):
        return frame, None
    apart = spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{base_dir}/{name}{APART}")
    return frame.unionByName(apart), (frame, apart)


def load_stored(spark: SparkSession, base_dir: str, prefix: str, heavy: dict[str, list[int]]) -> Tables:
    """Read a stored copy. A table with rows stored apart is the union of both
    parts."""
    frames, in_place = {}, {}
    for name in Tables.names():
        frames[name], parts = _load_table(spark, name, base_dir, prefix, heavy)
        if parts:
            in_place[name] = parts
    return Tables(**frames, heavy=heavy, _in_place=in_place)


class TablesOnUse(Tables):
    """A stored copy whose tables are written when they are first used, and
    whose heavy keys are settled when a join or a table first asks for them: a
    query stores the tables it reads and no others."""

    def __init__(self, spark: SparkSession, stored: Callable[[str], tuple], settled: Callable[[], dict]) -> None:
        own = dict(_spark=spark, _stored=stored, _settled=settled, _lock=threading.RLock(), _in_place={}, _shares={}, _checked={}, _plans={})
        for name, value in own.items():
            object.__setattr__(self, name, value)

    def __getattr__(self, name: str):  # reached by what isn't there yet
        if name not in TABLE_SCHEMAS and name != "heavy":
            raise AttributeError(name)
        with self._lock:  # one thread writes, others wait for it
            if name not in self.__dict__:
                if name == "heavy":
                    value = self._settled()
                else:
                    value, parts = self._stored(name)
                    if parts:
                        self._in_place[name] = parts
                object.__setattr__(self, name, value)
        return self.__dict__[name]

    def __repr__(self) -> str:
        return f"TablesOnUse({', '.join(n for n in self.names() if n in self.__dict__)})"

    __hash__ = object.__hash__

    def __eq__(self, other) -> bool:
        return self is other

    @property
    def spark(self) -> SparkSession:
        return self._spark


#: records of a layout, numbered; the newest complete one holds
RECORDS = "_records"
#: versions kept besides the newest, for jobs that still read them
KEEP_VERSIONS = 1
_RECORD_NAME = re.compile(r"(\d{10})\.json")


def _prefix_for(folder: str) -> str:
    return f"clinicledger_{hashlib.sha256(folder.encode()).hexdigest()[:16]}"


def _file_system(spark: SparkSession, path: str):
    """A path and its file system."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_json(spark: SparkSession, path: str) -> dict | None:
    """A small JSON file; None if it is missing or cut short."""
    hpath, fs = _file_system(spark, path)
    if not fs.exists(hpath):
        return None
    stream = fs.open(hpath)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


def _write_json(spark: SparkSession, path: str, value: dict) -> bool:
    """Write a small JSON file whole: aside first, then renamed to ``path``.
    False if ``path`` is taken; an existing file is never touched."""
    target, fs = _file_system(spark, path)
    if fs.exists(target):
        return False
    aside, _ = _file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    if fs.rename(aside, target):
        return True
    fs.delete(aside, False)
    return False


def _record_numbers(spark: SparkSession, base_dir: str) -> list[int]:
    """Numbers of the layout's records, newest first."""
    folder, fs = _file_system(spark, f"{base_dir}/{RECORDS}")
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted((int(m[1]) for m in map(_RECORD_NAME.fullmatch, names) if m), reverse=True)


def _record_path(base_dir: str, number: int) -> str:
    return f"{base_dir}/{RECORDS}/{number:010d}.json"


def _read_record(spark: SparkSession, base_dir: str, on_use: bool = False) -> dict | None:
    """The newest complete record: version folder, bucket count, fingerprint,
    heavy keys. One of a version stored on use, which may lack tables, only
    counts with ``on_use``."""
    for number in _record_numbers(spark, base_dir):
        record = _read_json(spark, _record_path(base_dir, number))
        if record is not None and (on_use or not record.get("on_use")):
            return record
    return None


def _write_record(spark: SparkSession, base_dir: str, record: dict) -> None:
    """Add ``record`` under the next free number. Earlier records stay, so a
    stop at any moment leaves the newest complete one in force; of two
    writers each gets a number of its own."""
    number = max(_record_numbers(spark, base_dir), default=0) + 1
    while not _write_json(spark, _record_path(base_dir, number), record):
        number += 1


def _drop_old(spark: SparkSession, base_dir: str, keep: int) -> None:
    """Remove records, and versions that none of the newest ``keep + 1``
    different ones names. A record goes before its folder."""
    kept: list[str] = []
    gone: list[str] = []
    for number in _record_numbers(spark, base_dir):
        path = _record_path(base_dir, number)
        record = _read_json(spark, path)
        folder = record["folder"] if record else None
        if folder in kept and number != _record_numbers(spark, base_dir)[0]:
            _remove(spark, path)
        elif folder is not None and len(kept) <= keep:
            kept.append(folder)
        else:
            _remove(spark, path)
            if folder:
                gone.append(folder)
    for folder in {*gone} - {*kept}:
        _remove(spark, f"{base_dir}/{folder}")
        for name in BUCKETS:
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(_prefix_for(f'{base_dir}/{folder}'), name)}")


def _remove(spark: SparkSession, path: str) -> None:
    hpath, fs = _file_system(spark, path)
    fs.delete(hpath, True)


def store_tables(
    tables: Tables, base_dir: str, buckets: int | None = None, check_keys: bool = False, keep: int = KEEP_VERSIONS,
    least_heavy: int = LEAST_ROWS,
) -> Tables:
    """Write ``tables`` under ``base_dir`` in the report layout and return
    the stored tables.

    Each source state and bucket count has a version folder of its own: a
    repeated call finds its version, an interrupted one resumes it, and
    changed data or another count makes a new one next to it. The record is
    written last, after the key check, so a version that is incomplete or
    rejected is never opened. Everything read later comes from the record.
    Then versions older than the newest and ``keep`` more are removed.

    ``least_heavy``: rows of one key from which on it may be heavy
    (``operators.skew``). The heavy keys of a version are settled before its
    tables, so a resumed write splits them alike.
    """
    spark = tables.spark
    base_dir = base_dir.rstrip("/")
    record = _version(tables, buckets, least_heavy)
    folder, buckets = f"{base_dir}/{record['folder']}", record["buckets"]
    newest = _read_record(spark, base_dir)
    if newest is None or {k: newest.get(k) for k in record} != record:
        heavy = _settled_heavy(tables, folder, buckets, least_heavy)
        save_tables(tables, folder, _prefix_for(folder), buckets, heavy)
        if check_keys:
            assert_unique_keys(load_stored(spark, folder, _prefix_for(folder), heavy))
        _write_record(spark, base_dir, {**record, "heavy": heavy})
        _drop_old(spark, base_dir, keep)
    elif check_keys:
        assert_unique_keys(open_stored(spark, base_dir))
    return open_stored(spark, base_dir)


def _version(tables: Tables, buckets: int | None, least_heavy: int) -> dict:
    """What a record says of the version that ``tables`` are stored as."""
    buckets = buckets or default_buckets(tables.spark, largest_table_bytes(tables))
    source = source_fingerprint(tables)
    version = hashlib.sha256(f"{source} {buckets} {least_heavy} {LAYOUT_VERSION}".encode()).hexdigest()[:20]
    return {"folder": version, "buckets": buckets, "source": source, "layout": LAYOUT_VERSION}


def _settled_heavy(tables: Tables, folder: str, buckets: int, least_heavy: int) -> dict[str, list[int]]:
    """The heavy keys of a version, found once and kept in its folder."""
    spark, settled = tables.spark, f"{folder}/_heavy.json"
    if _read_json(spark, settled) is None:
        with shuffles_freed(spark):
            summary = heavy_summary(tables, buckets, least_heavy, lambda name: shares_of(tables, name))
        _write_json(spark, settled, summary)
    return _read_json(spark, settled)


def store_on_use(
    tables: Tables, base_dir: str, buckets: int | None = None, keep: int = KEEP_VERSIONS, least_heavy: int = LEAST_ROWS
) -> Tables:
    """As ``store_tables``, but a table is written when it is first used. The
    files of this moment are what is stored: if they have changed when a table
    is to be written, this fails rather than mix two states. Other sessions
    find the tables written so far."""
    spark = tables.spark
    base_dir = base_dir.rstrip("/")
    record = _version(tables, buckets, least_heavy)
    folder, buckets = f"{base_dir}/{record['folder']}", record["buckets"]
    prefix = _prefix_for(folder)
    newest = _read_record(spark, base_dir, on_use=True)
    if newest is None or {k: newest.get(k) for k in record} != record:
        _write_record(spark, base_dir, {**record, "on_use": True})
        _drop_old(spark, base_dir, keep)

    files = _files_state(tables)

    def unchanged() -> None:
        if _files_state(tables) != files:
            raise RuntimeError("the source files have changed since this copy was begun")

    def settled() -> dict[str, list[int]]:
        if not _path_exists(spark, f"{folder}/_heavy.json"):
            unchanged()
        return _settled_heavy(tables, folder, buckets, least_heavy)

    def stored(name: str) -> tuple:
        # only rows under heavy keys lie apart
        heavy = copy.heavy if name in SPLIT_TABLES else {}
        if not _path_exists(spark, f"{folder}/{name}/_SUCCESS"):
            unchanged()
        save_table(tables, name, folder, prefix, buckets, heavy)
        return _load_table(spark, name, folder, prefix, heavy)

    copy = TablesOnUse(spark, stored, settled)
    return copy


def is_stored(spark: SparkSession, base_dir: str) -> bool:
    return _read_record(spark, base_dir.rstrip("/")) is not None


def open_stored(spark: SparkSession, base_dir: str) -> Tables:
    """Open tables written by ``store_tables`` in this or another session:
    bucketed tables are (re)registered in the session catalog from the
    record's folder and bucket count, so Spark knows their partitioning."""
    base_dir = base_dir.rstrip("/")
    record = _read_record(spark, base_dir)
    if record is None:
        raise FileNotFoundError(f"no stored layout in {base_dir}")
    folder = f"{base_dir}/{record['folder']}"
    prefix = _prefix_for(folder)
    for name in BUCKETS:
        table = _table_name(prefix, name)
        if not spark.catalog.tableExists(table):
            _register(spark, table, name, f"{folder}/{name}", record["buckets"])
    return load_stored(spark, folder, prefix, record["heavy"])


def stored_copy(spark: SparkSession, tables: Tables, tag: str, buckets: int | None = None) -> Tables:
    """Tables read back from a copy under ``spark.checkpoint.dir``; each table
    is written on first use (per ``tag`` and state of the source files) and
    reused afterwards. This cuts the lineage of derived tables: reports read
    stored, co-located tables, and a lost executor recomputes nothing before
    the copy."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    digest = hashlib.sha256(tag.encode()).hexdigest()[:16]
    return store_on_use(tables, f"{root}/clinicledger-tables/{digest}", buckets)


def materialize_enabled() -> bool:
    return os.environ.get("CLINICLEDGER_MATERIALIZE", "1") not in ("0", "false", "no")
