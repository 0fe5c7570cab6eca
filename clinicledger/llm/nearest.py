"""Operator 10: nearest neighbours by a block matrix join.

Unit vectors are quantised to int8 with a scale each.  A tile is the product
of a block of query codes and a block of candidate codes (integers, exact in
float32 up to 1,040 dimensions).  With e the length of a vector's quantisation
error, |q.c - tile| <= eq * (1 + ec) + (1 + eq) * ec + eq * ec, so a candidate
whose upper bound lies below the k-th best lower bound seen is out for sure.
The rest are recomputed in double precision from the original vectors and
merged by bounded heaps per query, first in the task, then across tasks.

Queries go to all tasks in blocks of at most about ``QUERIES``; candidates
aren't shuffled.  Nothing is approximate in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinicledger.llm.common import scratch_path, stored

QUERIES = 4096
_TILE_Q, _TILE_C = 512, 4096


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id``, ``v`` (doubles) of the rows that take part: an id, and a
    vector that isn't null, empty or zero and has only finite components."""
    v = F.col("v")
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & v.isNotNull()
        & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
        & F.exists(v, lambda x: x != 0)
    )


def quantise(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as floats), scales and error lengths of unit rows."""
    scale = np.abs(rows).max(axis=1) / 127
    codes = np.rint(rows / scale[:, None])
    error = np.sqrt(((rows - codes * scale[:, None]) ** 2).sum(axis=1)) + 1e-9
    return codes.astype(np.float32 if rows.shape[1] <= 1040 else np.float64), scale, error


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of paired rows, summed over the components in order."""
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        dot += x * y
        aa += x * x
        bb += y * y
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1)[:, None]  # no overflow in the norm
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


class Heaps:
    """The k best (score, smaller id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.zeros((n, k), np.int64)

    def merge(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        touched = np.unique(query)
        old = np.repeat(touched, self.k)
        q = np.r_[old, query]
        s = np.r_[self.score[touched].ravel(), score]
        i = np.r_[self.id[touched].ravel(), ids]
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.score[q[keep], place[keep]] = s[keep]
        self.id[q[keep], place[keep]] = i[keep]


def _join(shipped, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, Heaps] = {}
        queries = shipped.value  # by dimension: row numbers, ids, originals, codes, scales, errors
        for batch in batches:
            lists = batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            every = batch.column("id").to_numpy()
            for dim in set(sizes.tolist()) & set(queries):
                rows = np.flatnonzero(sizes == dim)
                c_all = flat[starts[rows][:, None] + np.arange(dim)]
                _, q_ids, q_rows, q_codes, q_scale, q_error = queries[dim]
                best = heaps.setdefault(dim, Heaps(len(q_ids), k))
                for at in range(0, len(rows), _TILE_C):
                    c, ids = _fewest(c_all[at:at + _TILE_C], every[rows[at:at + _TILE_C]], k + 1)
                    codes, scale, error = quantise(_unit(c))
                    for q0 in range(0, len(q_ids), _TILE_Q):
                        part = slice(q0, q0 + _TILE_Q)
                        tile = (q_codes[part] @ codes.T) * q_scale[part, None] * scale[None, :]
                        eq, ec = q_error[part, None], error[None, :]
                        slack = eq * (1 + ec) + (1 + eq) * ec + eq * ec
                        own = q_ids[part, None] == ids[None, :]
                        low = np.where(own, -np.inf, tile - slack)
                        floor = best.score[part, -1]
                        if len(ids) > k:
                            floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
                        q, at_c = np.nonzero((tile + slack >= floor[:, None]) & ~own)
                        for s in range(0, len(q), 1 << 16):  # bounded, however many tie
                            qs, cs = q[s:s + (1 << 16)] + q0, at_c[s:s + (1 << 16)]
                            best.merge(qs, ids[cs], cosines(q_rows[qs], c[cs]))
        for dim, best in heaps.items():
            q, place = np.nonzero(best.score > -np.inf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(queries[dim][0][q]), pa.array(queries[dim][1][q]),
                 pa.array(best.id[q, place]), pa.array(best.score[q, place])],
                ["q", "query_id", "vec_id", "score"],
            )
    return run


def _fewest(rows: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors the n smallest ids: no other can be among a query's
    n - 1 nearest, as all have the same score."""
    packed = np.ascontiguousarray(rows).view(f"V{rows.shape[1] * 8}").ravel()
    _, group = np.unique(packed, return_inverse=True)
    order = np.lexsort((ids, group))
    place = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    keep = np.sort(order[place < n])
    return rows[keep], ids[keep]


def _pack(rows: list[tuple[int, int, list[float]]]) -> dict:
    out = {}
    for dim in {len(v) for _, _, v in rows}:
        mine = [r for r in rows if len(r[2]) == dim]
        vectors = np.array([v for _, _, v in mine], np.float64)
        out[dim] = (np.array([r[0] for r in mine]), np.array([r[1] for r in mine]), vectors, *quantise(_unit(vectors)))
    return out


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` rows
    of ``vectors`` with the largest cosine to each row of ``queries``, ties to
    the smaller id, fewer if there are fewer.

    Rows without an id and vectors that are null, empty, zero or not finite
    take no part; a query meets only vectors of its own dimension and no row
    of its own id.  Repeated rows of ``vectors`` count each; repeated queries
    are answered each.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    numbered = usable(queries, id_col, vec_col).withColumn("q", F.monotonically_increasing_id())
    numbered = stored(numbered, "queries")
    candidates = usable(vectors, id_col, vec_col)
    blocks = max(1, -(-numbered.count() // QUERIES))
    path = scratch_path(spark, "nearest")
    schema = "q long, query_id long, vec_id long, score double"
    for b in range(blocks):  # a block's size is bounded; their number follows the query set's
        rows = numbered.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).select("q", "id", "v").collect()
        if rows:
            shipped = spark.sparkContext.broadcast(_pack([(r["q"], r["id"], r["v"]) for r in rows]))
            per_query = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
            (
                candidates.mapInArrow(_join(shipped, k), schema)
                .withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score").write.parquet(f"{path}/block={b}")
            )
    out = "query_id long, rank int, vec_id long, score double"
    if numbered.isEmpty():
        return spark.createDataFrame([], out)
    return spark.read.schema(out).parquet(path).select("query_id", "rank", "vec_id", "score")
