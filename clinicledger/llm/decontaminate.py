"""Operator 1: benchmark decontamination by size-partitioned MinHash
containment search.

A document's set of distinct ``width``-word shingles is put in a size
partition (the next power of two of its size) and sketched by one-permutation
MinHash with four bins per possible member: the sorted hashes are cut into
bins by their top bits, each bin keeps its smallest.  The number of bins
follows the size, so a short test item still meets enough of its minima in a
long document, which one fixed sketch size couldn't give.  Items are sketched
once per partition.  An item that shares a minimum with a document is a
candidate; items under ``SHORT`` shingles are looked up by their smallest
q - c + 1 hashes in the whole set (c the number that must be contained), which
can't miss.  Candidates are verified by exact containment:
100 * |item and document| >= percent * |item|.

A contained shingle is its bin's minimum with a chance of at least 0.88, so an
item of 16 shingles with 13 in the document is missed with a chance below
1e-11.

Documents aren't shuffled.  Items go to the tasks in blocks of at most about
``BLOCK`` items and ``BLOCK_BYTES`` of text; each further block is one more pass over the
documents.  A block's index is one sorted array for all size partitions: a
hash is a minimum of its item's sketch from that number of bins on at which
its bin parts from the next smaller hash's, and this number stands beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicledger.llm.common import small, stored
from clinicledger.llm.shingles import ALNUM, U, batches_by_bytes, common, shingle_sets

SHORT = 16
BINS_PER_MEMBER = 4
#: items, and bytes of their texts, in a pass: about 3 million shingles and
#: 70 MB of index for words of five letters
BLOCK, BLOCK_BYTES = 50_000, 16 << 20
_MAP_BITS = 22


def partition(size: int) -> int:
    """Size partition of a set: sizes up to 2**partition."""
    return max(0, int(size - 1).bit_length())


def sketch_bits(part: int) -> int:
    """Top bits of a hash that name its bin in a size partition's sketch."""
    return min(63, part + BINS_PER_MEMBER.bit_length() - 1)


def is_minimum(shingles: np.ndarray, part: int) -> np.ndarray:
    """Which hashes of a sorted set are the smallest in their bins."""
    bins = shingles >> U(64 - sketch_bits(part))
    return np.r_[True, bins[1:] != bins[:-1]][:len(shingles)]


def minimum_from(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each hash of sorted sets laid end to end: the least bits at which it
    is a minimum of its set's sketch."""
    differ = np.r_[U(0), flat[1:] ^ flat[:-1]][:len(flat)]
    high, low = (differ >> U(32)).astype(np.float64), (differ & U(0xFFFFFFFF)).astype(np.float64)
    length = np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])
    least = 65 - length
    least[offsets[:-1][np.diff(offsets) > 0]] = 0
    return least.astype(np.uint8)


class ItemIndex:
    """Hashes of a block of items as sorted arrays."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        sizes = np.array([len(s) for s in sets], np.int64)
        self.offsets = np.r_[0, np.cumsum(sizes)]
        self.flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        self.maybe = np.zeros(1 << _MAP_BITS, bool)  # hashes of any item, by top bits
        self.maybe[self.flat >> U(64 - _MAP_BITS)] = True
        item = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        size = sizes[item]
        place = np.arange(len(item)) - self.offsets[item]
        # short items: any of their smallest hashes; others: minima
        least = np.where(size < SHORT, 0, minimum_from(self.flat, self.offsets)).astype(np.uint8)
        used = np.flatnonzero((size >= SHORT) | (place < size + 1 + -percent * size // 100))
        order = used[np.argsort(self.flat[used], kind="stable")]
        self.hashes, self.item, self.least, self.short = self.flat[order], item[order], least[order], size[order] < SHORT

    def item_set(self, k: int) -> np.ndarray:
        return self.flat[self.offsets[k]:self.offsets[k + 1]]

    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def search(self, shingles: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) of the items contained in a set."""
        near = np.flatnonzero(self.maybe[shingles >> U(64 - _MAP_BITS)])
        if not len(near):
            return []
        part = partition(len(shingles))
        wanted = shingles[near]
        first = np.searchsorted(self.hashes, wanted, side="left")
        counts = np.searchsorted(self.hashes, wanted, side="right") - first
        if not counts.any():
            return []
        ends = np.cumsum(counts)
        at = np.arange(ends[-1]) + np.repeat(first - (ends - counts), counts)
        minimum = np.repeat(is_minimum(shingles, part)[near], counts)
        hit = self.short[at] | (minimum & (self.least[at] <= sketch_bits(part)))
        out = []
        for k in np.unique(self.item[at[hit]]).tolist():
            mine = self.item_set(k)
            shared = common(mine, shingles)
            if 100 * shared >= self.percent * len(mine):
                out.append((k, shared))
        return out


def _search(items, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, index = items.value
        for whole in batches:
            for batch in batches_by_bytes(whole, "text"):
                rows, which, shared = [], [], []
                for row, s in enumerate(shingle_sets(batch.column("text"), width, ALNUM)):
                    for k, n in index.search(s):
                        rows.append(row)
                        which.append(k)
                        shared.append(n)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(rows, pa.int64())),
                         pa.array([numbers[k] for k in which], pa.int64()), pa.array(shared, pa.int64()),
                         pa.array([len(index.item_set(k)) for k in which], pa.int64())],
                        ["doc_id", "item_id", "n_shared", "n_item"],
                    )
    return run


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_shared``, ``n_item``, ``containment`` of
    every document row and benchmark item that it contains.

    Words are runs of ASCII letters and digits and of non-ASCII characters,
    A-Z as a-z.  A text with fewer than ``width`` words has its whole
    sequence as one shingle.  Null or wordless texts contain nothing and are
    contained in nothing.  Null ids are kept as null; repeated rows give
    repeated results (repeated items too).  Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = stored(
        benchmark.filter("text is not null")
        .select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row")),
        "items",
    )
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK), -(-size // BLOCK_BYTES))
    found = []
    for b in range(blocks):  # a block's size is bounded; their number follows the benchmark's
        part = items.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow()
        sets = list(shingle_sets(part.column("text").combine_chunks() if part.num_rows else pa.array([], pa.string()), width, ALNUM))
        shipped = spark.sparkContext.broadcast((part.column("item_id").to_pylist(), ItemIndex(sets, percent)))
        found.append(rows.mapInArrow(_search(shipped, width), "doc_id long, item_id long, n_shared long, n_item long"))
    return reduce(DataFrame.unionByName, found).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item; columns unchanged.
    A row without a doc_id is judged by its text."""
    keyed = docs.withColumn("__row", F.xxhash64("text"))
    found = leaks(docs.select(F.xxhash64("text").alias("doc_id"), "text"), benchmark, width, percent)
    gone = small(stored(found.select(F.col("doc_id").alias("__row")).distinct(), "leaks"))
    return keyed.join(gone, "__row", "left_anti").select(*docs.columns)
