"""Hot keys, memory of an index, adverse texts and clashing names."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from clinicledger.llm import decontaminate, near_dedup, pii, token_counts
from clinicledger.llm.common import BROADCAST_BYTES, small, tell_workers
from test_llm_pairs import frame, near_brute, shingle_set


@pytest.fixture(autouse=True)
def _workers(spark):
    tell_workers(spark)


def templates(seed, n):
    """Texts of few templates with fields from few and from many values:
    shared shingles everywhere, sizes of a few words, similarities around the
    threshold."""
    rng = random.Random(seed)
    bodies = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([8, 10, 14, 20, 30, 45]))] for _ in range(5)]
    texts = []
    for k in range(n):
        words = list(rng.choice(bodies))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(words) + 1)
            words[at:at + rng.randint(0, 1)] = [rng.choice(["a", "b", "c", f"n{k}", f"n{rng.randrange(40)}"])]
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80), (1, 80)])
def test_hot_shingles_joined_by_sizes_lose_no_link(spark, monkeypatch, width, percent):
    monkeypatch.setattr(near_dedup, "HOT", 2)
    monkeypatch.setattr(near_dedup, "DEALT", 3)
    texts = templates(width, 220)
    sets = [shingle_set(t, width, r"[^\x20\x09-\x0D]+") for t in texts]
    wanted = {(i, j) for j in range(220) for i in range(j) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "node long, label long, text string")
    schema = "token long, at long, node long, label long, n long, " + ", ".join(f"w{k} long" for k in range(near_dedup.WORDS))
    for frequent in ({}, {int(t): 9 for t in rows.mapInArrow(near_dedup._tokens(width), "token long").toPandas().token.value_counts().index[:20]}):
        prefix = rows.mapInArrow(near_dedup._prefix(width, percent, frequent), schema).cache()
        pairs = [tuple(r) for r in near_dedup._prefix_pairs(prefix, percent).collect()]
        assert len(pairs) == len(set(pairs)) and wanted <= set(pairs)
    got = near_dedup.near_duplicates(frame(spark, texts), width, percent).collect()
    assert sorted((tuple(r) for r in got), key=repr) == near_brute(list(enumerate(texts)), width, percent)


def test_texts_just_under_the_threshold_make_no_pairs(spark):
    texts = [f"your order has been shipped to you and will arrive soon n{k}" for k in range(400)]
    rows = spark.createDataFrame(
        [(7, 1, k, k, 10, *[0] * near_dedup.WORDS) for k in range(400)] + [(k + 100, 0, k, k, 10, *[0] * near_dedup.WORDS) for k in range(400)],
        "token long, at long, node long, label long, n long, " + ", ".join(f"w{k} long" for k in range(near_dedup.WORDS)),
    )
    assert near_dedup._prefix_pairs(rows, 85).count() == 0
    got = near_dedup.near_duplicates(frame(spark, texts), 3, 85)
    assert got.filter("not kept").isEmpty()


def test_size_classes_are_consecutive():
    starts = near_dedup.class_starts(5000)
    classes = near_dedup.size_class(np.arange(5001))
    assert set(np.diff(classes)) <= {0, 1} and classes[0] == 0
    for n in range(5001):
        assert starts[classes[n]] <= n < starts[classes[n] + 1]


def test_item_index_is_small_and_knows_all_minima():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**64, 46, dtype=np.uint64)) for _ in range(50_000)]
    index = decontaminate.ItemIndex(sets, 80)
    assert index.nbytes() < 100e6
    offsets = np.r_[0, np.cumsum([len(s) for s in sets[:200]])]
    least = decontaminate.minimum_from(np.concatenate(sets[:200]), offsets)
    for part in (0, 2, 6, 12, 40):
        for k, s in enumerate(sets[:200]):
            assert np.array_equal(decontaminate.is_minimum(s, part), least[offsets[k]:offsets[k + 1]] <= decontaminate.sketch_bits(part))


def test_items_of_many_sizes_are_found_by_every_block(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(500)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([3, 5, 9, 25, 80])))) for k in range(120)]
    docs = [(k, " ".join([*rng.choices(words, k=rng.choice([0, 10, 1000])), items[k % 120][1], *rng.choices(words, k=9)])) for k in range(160)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = frame(spark, [t for _, t in docs])
    found = []
    for size in (decontaminate.BLOCK_BYTES, 2000):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        found.append({(r.doc_id, r.item_id) for r in decontaminate.leaks(table, bench).collect()})
    assert found[0] == found[1]
    assert {(k, k % 120) for k in range(160) if len(items[k % 120][1].split()) >= 5} <= found[0]


ADVERSE = {
    "labels": lambda n: "x@" + "a." * (n // 2) + "com",
    "labels and a digit": lambda n: "x@" + "ab." * (n // 3) + "9",
    "one label": lambda n: "x@" + "a" * n + ".com",
    "local part": lambda n: "a.b+" * (n // 4) + "@example.com",
    "digits": lambda n: "1" * n,
    "hexadecimal": lambda n: "deadbeef" * (n // 8),
    "password": lambda n: "password=" + "x" * n,
    "passwords": lambda n: "password=" * (n // 9),
    "access keys": lambda n: "AKIA" * (n // 4),
    "octets": lambda n: "1.2.3." * (n // 6),
    "dates": lambda n: "2021-02-03 " * (n // 11),
    "at": lambda n: "@" * n,
    "mails": lambda n: "a@b.co " * (n // 7),
}


@pytest.mark.parametrize("size", [4_000, 100_000, 1_000_000])
def test_pseudonyms_survive_adverse_texts(spark, size):
    """In the engine's threads, with their own stack."""
    names = list(ADVERSE) if size < 1_000_000 else [n for n in ADVERSE if n not in ("dates", "mails", "octets", "passwords")]
    docs = spark.createDataFrame([(k, ADVERSE[name](size)) for k, name in enumerate(names)], "doc_id long, text string").repartition(4)
    got = {names[r.doc_id]: (r.length, r.n_pii) for r in pii.pseudonymise(docs, "k").selectExpr("doc_id", "length(text) as length", "n_pii").collect()}
    assert all(length == len(ADVERSE[name](size)) for name, (length, _) in got.items())
    assert got["local part"][1] == 1 and got["labels"][1] == got["at"][1] == got["digits"][1] == 0


def test_pseudonyms_of_plain_values_by_an_independent_finder(spark):
    """Values put into texts at known places: all of them, and nothing else,
    change."""
    rng = random.Random(6)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + (k % 2)), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def card():
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(body + c for c in "0123456789" if luhn(body + c))

    values = [
        card, lambda: f"{rng.randint(1, 600):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}",
        lambda: f"{rng.randint(1900, 2100)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
        lambda: f"user{rng.randint(0, 999)}@mail{rng.randint(0, 99)}.sub.example.org",
    ]
    rows, places = [], []
    for k in range(150):
        parts, mine = [], []
        for _ in range(rng.randint(0, 4)):
            parts.append("some words of text,")
            mine.append((len(" ".join(parts)) + 1, v := rng.choice(values)()))
            parts.append(v)
        parts.append("and an end")
        rows.append((k, " ".join(parts)))
        places.append(mine)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.pseudonymise(docs, "key").collect():
        old, mine = rows[r.doc_id][1], places[r.doc_id]
        assert len(r.text) == len(old) and r.n_pii == len(mine)
        rest_old, rest_new = old, r.text
        for at, v in reversed(mine):
            assert r.text[at:at + len(v)] != v and re.sub("[0-9a-z.]", "x", r.text[at:at + len(v)]) == re.sub("[0-9a-z.]", "x", v)
            rest_old, rest_new = (t[:at] + t[at + len(v):] for t in (rest_old, rest_new))
        assert rest_old == rest_new


def test_context_table_takes_any_group_name(spark):
    rows = [("a", 3, 2), ("a", 9000, 1), ("b", 3, 5), (None, 0, 1)]
    plain = spark.createDataFrame(rows, "source string, length long, n_docs long")
    want = sorted(map(tuple, token_counts.context_table(plain, ["source"]).collect()), key=repr)
    for name in ("block", "d", "t", "d0", "_block", "bd", "_by_block", "docs_totals"):
        got = token_counts.context_table(plain.withColumnRenamed("source", name), [name])
        assert got.columns[0] == name
        assert sorted(map(tuple, got.collect()), key=repr) == want
    for name in token_counts.OUTPUT[2:]:
        with pytest.raises(ValueError):
            token_counts.context_table(plain.withColumnRenamed("source", name), [name])


def test_broadcasts_are_bounded_in_bytes(spark):
    wide = spark.range(3).selectExpr("id", f"repeat('x', {BROADCAST_BYTES // 2}) as text")
    has_hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert not has_hint(small(wide)) and not has_hint(small(spark.range(100).selectExpr(f"sequence(0, {BROADCAST_BYTES // 100}) as sums")))
    assert has_hint(small(spark.range(100)))
