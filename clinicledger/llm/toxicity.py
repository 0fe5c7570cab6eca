"""Operator 3: toxicity grades by cumulative-link ordinal regression.

A document's features are its words and word beginnings (4, 5 and 6 bytes),
hashed to ``DIMS`` numbers, each as log(1 + occurrences).  Features that the
sample doesn't tie to the labels (log-likelihood ratio up to ``TIED``, about
one in 100,000 by chance) get no weight, so long clean texts don't add up
noise.  One weight vector w serves all ordered thresholds t1 < t2 < ...:
P(grade >= k) = sigmoid(w.x - t_k), fitted by maximum likelihood of the
grades with an L2 penalty.  The expected severity is the sum of these
probabilities over k.

The fit uses a bounded sample of labelled rows (``sample``, smallest hashes
of doc_id first); scoring covers all rows and texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicledger.llm.common import stored
from clinicledger.llm.shingles import ALNUM, U, batches_by_bytes, span_hashes, text_bytes, word_spans

BITS = 20
DIMS = 1 << BITS
BEGINNINGS = (4, 5, 6)
TIED = 20.0
_SALTS = [U(0x9E3779B97F4A7C15 * k % 2**64) for k in range(1, len(BEGINNINGS) + 2)]


def features(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature numbers of all words, one array per kind, and each text's
    range of words."""
    data, offsets = text_bytes(texts)
    starts, ends, first = word_spans(data, offsets, ALNUM)
    cut = [np.minimum(starts + n, ends) for n in BEGINNINGS]
    hashes = span_hashes(data, starts, ends, *cut)  # salted by kind below
    return [((h ^ salt) * U(0x9E3779B97F4A7C15) >> U(64 - BITS)).astype(np.int32) for h, salt in zip(hashes, _SALTS)], first


@dataclass
class OrdinalModel:
    weights: np.ndarray  # float32, DIMS
    thresholds: np.ndarray  # ascending

    def at_least(self, margin: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.., a column each."""
        return 1 / (1 + np.exp(-np.clip(margin[:, None] - self.thresholds[None, :], -60, 60)))


def _occurrences():
    """Per batch: each feature's texts and toxic texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_by_bytes(whole, "text"):
                kinds, first = features(batch.column("text"))
                grades = batch.column("grade").to_numpy()
                texts = [np.unique(np.concatenate([k[a:b] for k in kinds])) for a, b in zip(first[:-1], first[1:])]
                ids, back = np.unique(np.concatenate(texts), return_inverse=True)
                toxic = np.repeat(grades > 0, [len(t) for t in texts])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.astype(np.int32)), pa.array(np.bincount(back, minlength=len(ids))),
                     pa.array(np.bincount(back, weights=toxic, minlength=len(ids)).astype(np.int64))],
                    ["feature", "n", "a"],
                )
    return run


def _sparse(tied: np.ndarray):
    """Each text's tied features and their values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(DIMS, bool)
        wanted[tied] = True
        for whole in batches:
            for batch in batches_by_bytes(whole, "text"):
                kinds, first = features(batch.column("text"))
                numbers, values = [], []
                for a, b in zip(first[:-1], first[1:]):
                    every = np.concatenate([k[a:b] for k in kinds])
                    ids, counts = np.unique(every[wanted[every]], return_counts=True)
                    numbers.append(ids.astype("<i4").tobytes())
                    values.append(np.log1p(counts).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("grade"), pa.array(numbers, pa.binary()), pa.array(values, pa.binary())],
                    ["grade", "numbers", "values"],
                )
    return run


def ties(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the features whose occurrence in the sample is tied to the
    labels, and whether to toxic texts.  Counted by Spark; few are tied."""
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("grade") > 0).cast("int")), F.lit(0))).first()
    if not 0 < toxic < n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    p = toxic / n
    part = lambda x, share: x * F.log(F.greatest(x, F.lit(1e-9)) / (F.col("n") * share))
    counts = sample.mapInArrow(_occurrences(), "feature int, n long, a long").groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum("a").alias("a")
    )
    ratio = 2 * (part(F.col("a"), p) + part(F.col("n") - F.col("a"), 1 - p))
    rows = counts.filter(ratio > TIED).select("feature", (F.col("a") > F.col("n") * p).alias("toxic")).orderBy("feature").collect()
    return np.array([r["feature"] for r in rows], np.int64), np.array([r["toxic"] for r in rows], bool)


def severity_grades(toxic: np.ndarray, ids: np.ndarray, row: np.ndarray, values: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 from 0/1 labels: of toxic texts, those with more than
    the median of occurrences of features tied to toxic texts are graded 2."""
    amount = np.bincount(row, weights=np.expm1(values) * marked[ids], minlength=len(toxic))
    grade = toxic.astype(np.int64)
    if toxic.any():
        grade[(toxic == 1) & (amount > np.median(amount[toxic == 1]))] = 2
    return grade


def fit_ordinal(
    grades: np.ndarray, ids: np.ndarray, row: np.ndarray, values: np.ndarray, rounds: int = 500, l2: float = 1e-5
) -> OrdinalModel:
    """Maximum likelihood by Adam over the whole sample.  Grades count from 0;
    a grade nobody has gets no threshold."""
    top = int(grades.max()) if len(grades) else 0
    if not top:
        return OrdinalModel(np.zeros(DIMS, np.float32), np.full(1, 60.0))
    used, ids = np.unique(ids, return_inverse=True)
    n = len(grades)
    share = np.array([(grades >= k).mean() for k in range(1, top + 1)])
    start = -np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1))
    gaps = np.log(np.maximum(np.diff(start), 1e-3))
    p = np.concatenate([np.zeros(len(used)), start[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    values = values.astype(np.float64)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for step in range(1, rounds + 1):
        w, t = p[:len(used)], np.concatenate([p[len(used):len(used) + 1], p[len(used)] + np.cumsum(np.exp(p[len(used) + 1:]))])
        f = np.bincount(row, weights=w[ids] * values, minlength=n)
        # P(y = g) = upper - lower, upper = P(y >= g), lower = P(y >= g + 1)
        bounds = np.concatenate([[-60.0], t, [60.0]])
        upper, lower = sigmoid(f - bounds[grades]), sigmoid(f - bounds[grades + 1])
        upper[grades == 0], lower[grades == top] = 1, 0
        prob = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        g_f = -(du - dl) / prob / n
        g_t = np.zeros(top)
        np.add.at(g_t, grades[grades > 0] - 1, (du / prob)[grades > 0] / n)
        np.add.at(g_t, grades[grades < top], -(dl / prob)[grades < top] / n)
        g_w = np.bincount(ids, weights=g_f[row] * values, minlength=len(used)) + l2 * w
        back = np.cumsum(g_t[::-1])[::-1]  # a threshold moves all above it
        grad = np.concatenate([g_w, back[:1], back[1:] * np.exp(p[len(used) + 1:])])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        p = p - 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-12)
    weights = np.zeros(DIMS, np.float32)
    weights[used] = p[:len(used)]
    return OrdinalModel(weights, np.concatenate([p[len(used):len(used) + 1], p[len(used)] + np.cumsum(np.exp(p[len(used) + 1:]))]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> OrdinalModel:
    """Fit on at most ``sample`` labelled documents (``doc_id``, ``toxic``
    0/1; repeated labels: the largest).  Rows with null ids or labels take
    no part; without labels the model finds nothing toxic."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("grade")
    )
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # bounded by sample
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("grade", "text")
    texts = stored(texts.limit(2 * sample), "labelled")  # ids of documents may repeat
    tied, to_toxic = ties(texts)
    if not len(tied):
        all_toxic = texts.filter("grade = 0").isEmpty() and not texts.isEmpty()
        return OrdinalModel(np.zeros(DIMS, np.float32), np.full(1, -60.0 if all_toxic else 60.0))
    rows = texts.mapInArrow(_sparse(tied), "grade int, numbers binary, values binary").toArrow()
    numbers = [np.frombuffer(x, "<i4") for x in rows.column("numbers").to_pylist()]
    values = [np.frombuffer(x, "<f4") for x in rows.column("values").to_pylist()]
    row = np.repeat(np.arange(len(numbers)), [len(x) for x in numbers])
    ids, vals = np.concatenate(numbers), np.concatenate(values)
    toxic = np.clip(np.asarray(rows.column("grade").to_pylist()), 0, 1).astype(np.float64)
    marked = np.zeros(DIMS, bool)
    marked[tied[to_toxic]] = True
    return fit_ordinal(severity_grades(toxic, ids, row, vals, marked), ids, row, vals)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        used = m.weights != 0
        for whole in batches:
            for batch in batches_by_bytes(whole, "text"):
                kinds, first = features(batch.column("text"))
                margin = np.zeros(batch.num_rows)
                for kind in kinds:
                    hit = np.flatnonzero(used[kind])
                    where = np.searchsorted(first, hit, side="right") - 1
                    pair, times = np.unique(where.astype(np.int64) << BITS | kind[hit], return_counts=True)
                    np.add.at(margin, pair >> BITS, m.weights[pair & (DIMS - 1)] * np.log1p(times))
                at_least = m.at_least(margin)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in batch.schema.names),
                     pa.array(at_least[:, 0]), pa.array(at_least.sum(axis=1)),
                     pa.array((at_least >= 0.5).sum(axis=1).astype(np.int32))],
                    [*batch.schema.names, "p_toxic", "severity", "grade"],
                )
    return run


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` with ``p_toxic`` (P(grade >= 1)), ``severity`` (expected
    grade) and ``grade`` (the largest k with P(grade >= k) >= 0.5).  Needs a
    ``text`` column; null and wordless texts get the scores of no features.
    Input columns of the three names are replaced."""
    from pyspark.sql.types import StructType

    docs = docs.drop("p_toxic", "severity", "grade").withColumn("text", F.col("text").cast("string"))
    schema = StructType(list(docs.schema.fields)).add("p_toxic", "double").add("severity", "double").add("grade", "integer")
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), schema)


def severities(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """``doc_id``, ``p_toxic``, ``severity``, ``grade`` of every row."""
    return score(docs.select("doc_id", "text"), fit(docs, labels, sample)).drop("text")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """The rows of ``docs`` of grade 0, columns unchanged."""
    return score(docs, fit(docs, labels, sample)).filter("grade = 0").select(*docs.columns)
