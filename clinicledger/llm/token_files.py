"""Operator 4: token ids as flat binary files.

Format, in one folder:

* ``ids-PPPPP-<attempt>.bin``: the ids of a run of documents, back to back,
  little-endian unsigned (16 bits if the vocabulary fits, else 32);
* ``docs-PPPPP-<attempt>.bin``: the run's n + 1 offsets into that file, in
  ids, as 64-bit integers, then its n doc_ids as 64-bit integers;
* ``shards``: a Parquet table with one row per run: its number, file names,
  documents (the first ``n_null`` without a doc_id), ids, and ``base``, the
  ids of all runs before it.  Bases come
  from prefix sums over the runs' sizes; a document's global offset is its
  run's base plus its own offset.

Documents are dealt by ranges of doc_id (equal ids by a hash of their texts),
so run numbers follow ascending doc_id.  Each attempt writes under a name of
its own, and only names in the committed ``shards`` table count, so lost
executors and repeated tasks leave at most unread files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinicledger.llm.encoder import encoder
from clinicledger.llm.shingles import batches_by_bytes

#: shards at most, so that their table stays small
MAX_SHARDS = 100_000
_RUN = "shard long, ids_file string, docs_file string, n_docs long, n_null long, n_ids long, width int"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _writer(folder: str, path: str | None, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        tag = f"{shard:05d}-{uuid.uuid4().hex[:12]}"
        store, root = _filesystem(folder)
        enc = encoder(path)
        names = [f"ids-{tag}.bin", f"docs-{tag}.bin"]
        n_docs = n_null = n_ids = 0
        keys: list[np.ndarray] = []
        ids_out = docs_out = None
        for whole in batches:
            for batch in batches_by_bytes(whole, "text"):
                if not batch.num_rows:
                    continue
                if ids_out is None:
                    store.create_dir(root, recursive=True)
                    ids_out = store.open_output_stream(f"{root}/{names[0]}")
                    docs_out = store.open_output_stream(f"{root}/{names[1]}")
                    docs_out.write(np.zeros(1, "<i8").tobytes())
                ids, ends = enc.encode(batch.column("text"))
                if end_id is not None:
                    ids = np.insert(ids, ends[1:], enc.dtype.type(end_id))
                    ends = ends + np.arange(len(ends))
                ids_out.write(ids.tobytes())
                docs_out.write((ends[1:] + n_ids).astype("<i8").tobytes())
                keys.append(batch.column("doc_id").fill_null(0).to_numpy())
                n_docs += batch.num_rows
                n_null += batch.column("doc_id").null_count
                n_ids += len(ids)
        if ids_out is not None:
            docs_out.write(np.concatenate(keys).astype("<i8").tobytes())
            ids_out.close()
            docs_out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([names[0]]), pa.array([names[1]]),
                 pa.array([n_docs], pa.int64()), pa.array([n_null], pa.int64()), pa.array([n_ids], pa.int64()), pa.array([enc.dtype.itemsize], pa.int32())],
                ["shard", "ids_file", "docs_file", "n_docs", "n_null", "n_ids", "width"],
            )
    return run


def write_tokens(
    docs: DataFrame, folder: str, end_id: int | None = 1, shards: int | None = None, tokenizer: str | None = None
) -> DataFrame:
    """Encode every whole ``text`` of ``docs``, append ``end_id`` to each and
    write the files above to ``folder`` (new; seen by all executors) in
    ascending ``doc_id`` order.  Returns the ``shards`` table.

    Null and empty texts have the end id only; null doc_ids come first;
    rows with equal doc_ids follow each other, ordered by their texts'
    hashes; repeated rows are all written.  An empty table gives no shard.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if n > MAX_SHARDS:
        raise ValueError(f"at most {MAX_SHARDS} shards")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("th"),
    )
    dealt = rows.repartitionByRange(n, "doc_id", "th").sortWithinPartitions("doc_id", "th")
    dealt.mapInArrow(_writer(f"{folder}/data", tokenizer, end_id), _RUN).write.parquet(f"{folder}/runs")
    dealt_ids = spark.read.schema(_RUN).parquet(f"{folder}/runs")
    # at most MAX_SHARDS rows: one window over all of them
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt_ids.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    bases.coalesce(1).write.parquet(f"{folder}/shards")
    return read_shards(spark, folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{_RUN}, base long").parquet(f"{folder}/shards")


def open_shard(folder: str, name: str, dtype) -> np.ndarray:
    """A file's values, memory-mapped where the folder is a file system's."""
    store, root = _filesystem(folder)
    if store.type_name == "local":
        return np.memmap(f"{root}/data/{name}", dtype, "r") if store.get_file_info(f"{root}/data/{name}").size else np.zeros(0, dtype)
    with store.open_input_file(f"{root}/data/{name}") as f:
        return np.frombuffer(f.read_buffer(), dtype)


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, ids_file, docs_file, n, n_null, width, base in zip(*(
                batch.column(c).to_pylist()
                for c in ("shard", "ids_file", "docs_file", "n_docs", "n_null", "width", "base")
            )):
                ids = open_shard(folder, ids_file, f"<u{width}")
                docs = open_shard(folder, docs_file, "<i8")
                ends, keys = docs[:n + 1], docs[n + 1:]
                for at in range(0, n, 8192):
                    part = np.asarray(ends[at:at + 8193])
                    places = np.arange(at, at + len(part) - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.asarray(keys[at:at + 8192]), mask=places < n_null),
                         pa.array(np.full(len(places), shard)), pa.array(places),
                         pa.array(part[:-1] + base), pa.array(np.diff(part)),
                         pa.array([zlib.crc32(np.asarray(ids[a:b]).astype("<u4")) for a, b in zip(part, part[1:])], pa.int64())],
                        ["doc_id", "shard", "place", "start", "n_tokens", "ids_crc32"],
                    )
    return run


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the files, read back: ``doc_id``, ``shard``, ``place``
    in it, ``start`` (ids of all documents before it), ``n_tokens`` and the crc32 of
    its ids as 32-bit integers."""
    shards = read_shards(spark, folder)
    n = max(1, shards.count())
    return shards.repartition(n, "shard").mapInArrow(
        _reader(folder), "doc_id long, shard long, place long, start long, n_tokens long, ids_crc32 long"
    )
