"""Decontamination, near-dedup, nearest neighbours, mixing: against brute
force on small tables, with the edge cases each operator defines."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest

from clinicledger.llm import decontaminate, mixing, near_dedup, nearest
from clinicledger.llm.common import tell_workers

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def _workers(spark):
    tell_workers(spark)


def vocabulary(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def frame(spark, texts, ids=None, extra=False):
    rows = [(i if ids is None else ids[i], t, "en", "s", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # columns named like the operators' own
        for name in ("th", "fp", "node", "label", "a", "b", "key", "kept", "component_id", "item_id", "rank", "score"):
            df = df.selectExpr("*", f"'x' as {name}")
    return df


def shingle_set(text, width, pattern):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(pattern, low)
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1))


def near_brute(rows, width, percent):
    sets = [shingle_set(t, width, r"[^\x20\x09-\x0D]+") for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and rows[i][0] is not None and rows[j][0] is not None:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(
        ((d, len(sets[i]), low.get(find(i)) if d is not None else None, d is None or low[find(i)] == d) for i, (d, _) in enumerate(rows)),
        key=repr,
    )


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    words = vocabulary(400)
    passage = rng.choices(words, k=60)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.4 or not texts:
            texts.append(" ".join(rng.choices(words, k=rng.choice([1, 2, 5, 30, 120, 300]))))
        elif kind < 0.6:
            texts.append(rng.choice(texts))  # exact copies
        elif kind < 0.8:  # a frequent passage and little else
            texts.append(" ".join(passage + rng.choices(words, k=rng.choice([3, 6, 10, 15, 25]))))
        else:  # near copies, chains of them too
            w = rng.choice(texts).split()
            for _ in range(max(1, len(w) // rng.choice([20, 40, 100]))):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append("  \n".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    return texts


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    texts = corpus(width) + ["", " \n\t", None, None, "one", "One", "two words", "two words here", "two words here"]
    ids = random.Random(5).sample(range(10_000), len(texts))
    got = near_dedup.near_duplicates(frame(spark, texts, ids, extra=True), width, percent).collect()
    assert sorted((tuple(r) for r in got), key=repr) == near_brute(list(zip(ids, texts)), width, percent)


def test_near_duplicates_null_and_repeated_ids_and_empty(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (1, "x y z w v u"), (2, "x y z w v u"), (3, None)]
    got = near_dedup.near_duplicates(frame(spark, [t for _, t in rows], [d for d, _ in rows]), 3, 85).collect()
    assert sorted((tuple(r) for r in got), key=repr) == near_brute(rows, 3, 85)
    assert near_dedup.near_duplicates(frame(spark, []), 3, 85).count() == 0
    docs = frame(spark, [t for _, t in rows], [d for d, _ in rows])
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == [1, 3, None]


def test_band_rows_and_densification():
    assert (near_dedup.band_rows(0.85), near_dedup.band_rows(0.8)) == (7, 6)
    # similar short sets meet in a bucket although nearly all bins are empty
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(300):
        s = np.sort(rng.integers(0, 2**64, 7, dtype=np.uint64))
        met += bool(set(near_dedup.band_keys(s, 7)) & set(near_dedup.band_keys(s[1:], 7)))
    assert met >= 298


def leaks_brute(docs, items, percent=80):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    out = []
    for i, t in items:
        q = shingle_set(t, 5, pattern)
        for d, text in docs:
            shared = len(q & shingle_set(text, 5, pattern))
            if q and 100 * shared >= percent * len(q):
                out.append((d, i, shared, len(q), shared / len(q)))
    return sorted(out, key=repr)


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    words = vocabulary(3000, 2)
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 7, 12, 20, 45])))) for k in range(60)]
    items += [(60, ""), (61, None), (None, " ".join(rng.choices(words, k=20))), (3, items[3][1])]
    docs = []
    for d in range(150):
        w = rng.choices(words, k=rng.choice([0, 3, 20, 400, 6000 if d % 50 == 0 else 100]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            q = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2])):  # changed, so some fall under the threshold
                if q:
                    q[rng.randrange(len(q))] = rng.choice(words)
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + rng.choice(["", ",", "."]) for x in q]
        docs.append((d, " ".join(w)))
    docs += [(None, items[5][1]), (7, None), (8, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as doc_id")
    table = frame(spark, [t for _, t in docs], [d for d, _ in docs], extra=True)
    want = leaks_brute(docs, items)
    for block in (decontaminate.BLOCK, 20):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        assert sorted((tuple(r) for r in decontaminate.leaks(table, bench).collect()), key=repr) == want
    left = decontaminate.drop_leaks(table, bench)
    assert left.columns == table.columns
    bad = {docs[k][1] for k in range(len(docs)) if leaks_brute([docs[k]], items)}
    assert sorted(r.text or "" for r in left.collect()) == sorted(t or "" for _, t in docs if t not in bad)
    assert decontaminate.leaks(frame(spark, []), bench).count() == 0
    assert decontaminate.leaks(table, bench.limit(0)).count() == 0


def nearest_brute(rows, k, is_query):
    good = [(i, np.array(v, np.float64)) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q in good:
        if is_query(i):
            near = sorted((-nearest.cosines(q[None], c[None])[0], j) for j, c in good if j != i and len(c) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near[:k])]
    return sorted(out)


def test_nearest_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 460)]  # ties
    rows += [(i, [x * 1000 for x in rows[8][1]]) for i in range(460, 464)]
    rows += [(500, None), (550, []), (600, [0.0] * 16), (650, [float("nan")] * 16), (700, [float("inf")] + [1.0] * 15),
             (750, [None] + [1.0] * 15), (None, rows[0][1]), (800, [1.0, 2.0]), (801, [2.0, 1.0]), (850, [1e-30] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "'x' as q", "'y' as id")
    want = nearest_brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 5, lambda i: i % 50 == 0)
    for q, tile in ((nearest.QUERIES, 4096), (3, 64)):
        monkeypatch.setattr(nearest, "QUERIES", q)
        got = nearest.nearest(df.filter("vec_id % 50 = 0"), df).collect()
        assert sorted(tuple(r) for r in got) == want
    assert nearest.nearest(df.limit(0), df).count() == 0
    assert nearest.nearest(df.filter("vec_id = 1"), df.limit(0)).count() == 0


def test_int8_bounds_hold():
    rng = np.random.default_rng(4)
    a = nearest._unit(rng.normal(size=(200, 64)) * rng.exponential(size=64))
    codes, scale, error = nearest.quantise(a)
    tile = (codes @ codes.T) * scale[:, None] * scale[None, :]
    slack = error[:, None] * (1 + error[None, :]) + (1 + error[:, None]) * error[None, :] + error[:, None] * error[None, :]
    assert (np.abs(tile - a @ a.T) <= slack).all() and slack.max() < 0.05


def test_poisson_replication(spark):
    texts = [f"text {i}" for i in range(3000)]
    rows = [(i, t, "en", "hot" if i % 3 else ("cold" if i % 2 else None), 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as copy", "1 as rate", "'y' as sums")
    out = mixing.replicate(df).cache()
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "rate", "sums", "copy"]
    sizes = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert all(abs(sizes[s] - 1000) < 5 * 1000 ** 0.5 for s in ("hot", "cold", None))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixing.replicate(df.repartition(7)).collect()))
    # counts follow the inverse distribution of each hash
    import hashlib
    import math
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    rate = {"hot": 0.5, "cold": 2.0, None: 2.0}
    for d, t, _, s, _ in rows[:500]:
        key = f"13|{d}|{hashlib.md5(t.encode()).hexdigest()}"
        u = int(hashlib.md5(key.encode()).hexdigest()[:12], 16) / 2**48
        n, total = 0, math.exp(-rate[s])
        while total <= u:
            n += 1
            total += math.exp(-rate[s] + n * math.log(rate[s]) - math.lgamma(n + 1))
        assert counts.get(d, 0) == n
    order = [r.doc_id for r in out.collect()]
    assert order != sorted(order)
    only = mixing.replicate(df, {"cold": 1.0}).groupBy("source").count().collect()
    assert [r.source for r in only] == ["cold"]
    assert mixing.replicate(df.limit(0)).count() == 0
    large = mixing.rates(df.filter("source = 'cold'").limit(1).unionByName(df.filter("source = 'hot'")), {"cold": 1.0})
    assert abs(large.selectExpr("max(sums[size(sums) - 1])").first()[0] - 1) < 1e-9  # rate 2001 doesn't underflow


def test_stable_hash_of_long_text(spark):
    """A very long text and one enormous word don't break the hashing."""
    from clinicledger.llm.shingles import NON_SPACE, shingle_sets
    import pyarrow as pa
    long = " ".join(str(zlib.crc32(str(i).encode())) for i in range(400_000))
    a, b, c = shingle_sets(pa.array([long, "x" * 3_000_000 + " y", long.upper()]), 3, NON_SPACE)
    assert len(a) == 399_998 and len(b) == 1 and (a == c).all()
