"""Operator 2: MinHash near-dedup.

One-permutation hashing: a document's sorted shingle hashes are cut into
``BINS`` bins by their top bits, the first hash in each bin is its minimum.
Empty bins are filled by optimal densification: bin j takes the value of the
first non-empty bin in a fixed random sequence of its own.  Bands of
``band_rows(threshold)`` bins give bucket keys.  Documents with equal sets
form a class first, and only class representatives go on.

Candidates are star-shaped: each bucket pairs a centre with its members, so
a bucket of m members gives m - 1 pairs.  Pairs are confirmed on full
shingle sets.  A star alone would lose a link between two members that their
centre doesn't confirm.  So members of buckets that still reach over several
components are joined again by an exact prefix filter: sets at the threshold
share one of their rarest shingles, and their parity bitmaps differ in no more
bits than the sets may differ in shingles.  Pairs inside a component aren't
made, and nothing caps a bucket.

A shingle in more than ``HOT`` prefixes is joined apart, by (shingle, size of
the one set, size of the other).  If it is the first shingle two sets share, it
stands at most n - t places from the front in a set of n, with t the
intersection that these two sizes need; later places don't enter the join.  So
texts that are equal but for more than the sizes allow make no pairs however
many they are.  Keys that one side lacks go before the join, and a key's rows
are dealt over several.  Texts of one template that differ in frequent shingles
only, and by just more than is allowed, still meet pairwise before the bitmaps.

The centre is the member with the smallest hash, in one of four hash orders
by band, so that a group whose copies aren't all similar to one of them is
tied together in the first round.

``band_rows`` takes the longest rows r for which a pair at the threshold s
shares no bucket with a chance (1 - s**r)**(256 // r) of at most 1e-5:
r = 7 (9e-7) at 0.85, r = 6 (3e-6) at 0.8; less for more similar pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicledger.llm.common import small, stored
from clinicledger.llm.components import components
from clinicledger.llm.shingles import NON_SPACE, U, batches_by_bytes, common, mix, shingle_sets

BINS = 256
CENTRE_ORDERS = 4
#: one in so many of the rest's documents tells which shingles are frequent,
#: and so many of those are told to all tasks; both only order the prefixes
SAMPLE, FREQUENT = 16, 200_000
#: 64-bit words of a set's parity bitmap
WORDS = 16
#: prefixes that hold a shingle, from which on it is joined by sizes too, and
#: the rows of a side of such a key that one salt takes
HOT, DEALT = 64, 2_048
_TOP = U(64 - 8)
_SEEDS = mix(np.arange(1, BINS + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93))
#: random bin sequences for densification, one row per bin
_PICKS = np.random.default_rng(7).integers(0, BINS, (BINS, 4096))


def band_rows(threshold: float) -> int:
    """Bins per band for a similarity threshold, by the rule above."""
    return max(r for r in range(1, BINS + 1) if r == 1 or (1 - threshold ** r) ** (BINS // r) <= 1e-5)


def band_keys(shingles: np.ndarray, rows: int) -> np.ndarray:
    """Bucket keys of a non-empty sorted shingle set."""
    bins = (shingles >> _TOP).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    full = np.zeros(BINS, bool)
    full[bins[first]] = True
    values = np.zeros(BINS, np.uint64)
    values[bins[first]] = shingles[first]
    empty = np.flatnonzero(~full)
    step = 0
    while len(empty):
        pick = _PICKS[empty, step % 4096]
        hit = full[pick]
        values[empty[hit]] = values[pick[hit]]
        empty = empty[~hit]
        step += 1
        if step == 4096:  # 1e-7 with one full bin in 256
            values[empty] = shingles[0]
            break
    bands = BINS // rows
    key = _SEEDS[:bands].copy()
    for column in values[:bands * rows].reshape(bands, rows).T:
        key = mix(key * U(0x2545F4914F6CDD1D) + column)
    return key


def _signatures(width: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_by_bytes(whole, "text"):
                sizes, prints, keys = [], [], []
                for s in shingle_sets(batch.column("text"), width, NON_SPACE):
                    sizes.append(len(s))
                    if len(s):
                        turned = mix(s ^ U(0xA5A5A5A5A5A5A5A5))
                        prints.append(np.array([mix(s + U(1)).sum(), turned.sum()], np.uint64).tobytes())
                        keys.append(band_keys(s, rows).view(np.int64))
                    else:
                        prints.append(None)
                        keys.append(np.zeros(0, np.int64))
                lists = pa.ListArray.from_arrays(
                    np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32), np.concatenate(keys)
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("th"), pa.array(sizes, pa.int64()),
                     pa.array(prints, pa.binary()), lists],
                    ["doc_id", "th", "n_shingles", "fp", "bands"],
                )
    return run


def _confirmed(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint64))  # the last centre
        for whole in batches:
            for batch in batches_by_bytes(whole, "text_b", 2 << 20):
                ids = batch.column("a").to_numpy()
                distinct, first, back = np.unique(ids, return_index=True, return_inverse=True)
                centres: list[np.ndarray | None] = [kept[1] if a == kept[0] else None for a in distinct]
                todo = [k for k, c in enumerate(centres) if c is None]
                rows = pa.array(first[todo])
                for k, s in zip(todo, shingle_sets(batch.column("text_a").take(rows), width, NON_SPACE)):
                    centres[k] = s
                good = np.zeros(len(ids), bool)
                for row, s in enumerate(shingle_sets(batch.column("text_b"), width, NON_SPACE)):
                    c = centres[back[row]]
                    shared = common(c, s)
                    good[row] = 100 * shared >= percent * (len(c) + len(s) - shared)
                kept = (int(ids[-1]), centres[back[-1]])
                mask = pa.array(good)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"]
                )
    return run


def _tokens(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_by_bytes(whole, "text"):
                found = [s.view(np.int64) for s in shingle_sets(batch.column("text"), width, NON_SPACE)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["token"])
    return run


def size_class(n: np.ndarray) -> np.ndarray:
    """Sets' size classes: sizes up to 64, then steps of 1/32."""
    n = np.asarray(n, np.int64)
    top = np.frexp(np.maximum(n, 64).astype(np.float64))[1] - 7  # doublings over 64
    return np.where(n <= 64, n, 64 + 32 * top + ((n >> np.maximum(top + 1, 1)) - 32))


def class_starts(upto: int) -> np.ndarray:
    """The smallest size of each class, up to the class of size ``upto``."""
    n, out = 0, []
    while n <= upto:
        out.append(n)
        n = n + 1 if n < 64 else n + (1 << (int(n).bit_length() - 6))
    return np.array([*out, n], np.int64)


def _roles(percent: int):
    """A prefix row once for each size class that the other set may have, as
    the larger (``big``) and as the smaller set, if its place allows it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, at = batch.column("n").to_numpy(), batch.column("at").to_numpy()
            starts = class_starts(int(n.max()) * 100 // percent + 1)
            own = size_class(n)
            rows, bigs, smalls, big = [], [], [], []
            for larger in (True, False):
                low = size_class(-(-n * percent // 100)) if larger else own
                high = own if larger else size_class(n * 100 // percent)
                reach = high - low + 1
                row = np.repeat(np.arange(len(n)), reach)
                other = np.arange(len(row)) - np.repeat(np.cumsum(reach) - reach - low, reach)
                need = -(-percent * (n[row] + starts[other]) // (100 + percent))
                keep = at[row] <= n[row] - need
                row, other = row[keep], other[keep]
                rows.append(row)
                bigs.append(own[row] if larger else other)
                smalls.append(other if larger else own[row])
                big.append(np.full(len(row), larger))
            row = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(row) for c in batch.schema.names), pa.array(np.concatenate(bigs)), pa.array(np.concatenate(smalls)), pa.array(np.concatenate(big))],
                [*batch.schema.names, "cx", "cy", "big"],
            )
    return run


def _prefix(width: int, percent: int, frequent: dict[int, int]):
    """The first n - ceil(percent/100 n) + 1 shingles of a set of n, those
    that aren't frequent first: sets at the threshold share one of them.
    With each, a bitmap of which of 64 * WORDS hash values the set has an odd
    number of times: two sets differ in at least as many shingles as their
    bitmaps do in bits."""
    known = np.array(sorted(frequent), np.int64)
    times = np.array([frequent[k] for k in known.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_by_bytes(whole, "text"):
                tokens, sizes, parities = [], [], []
                for s in shingle_sets(batch.column("text"), width, NON_SPACE):
                    odd = np.bincount((mix(s) >> U(54)).astype(np.int64), minlength=64 * WORDS) & 1
                    parities.append(np.packbits(odd.astype(np.uint8)))
                    t = s.view(np.int64)
                    rank = np.zeros(len(t), np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, t), len(known) - 1)
                        rank = np.where(known[at] == t, times[at], 0)
                    tokens.append(t[np.lexsort((t, rank))[:len(t) - -(-percent * len(t) // 100) + 1]])
                    sizes.append(len(t))
                reps = [len(t) for t in tokens]
                odd = np.repeat(np.array(parities).view("<i8").reshape(-1, WORDS), reps, axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens)), pa.array(np.concatenate([np.arange(r) for r in reps])),
                     *[pa.array(np.repeat(batch.column(c).to_numpy(), reps)) for c in ("node", "label")],
                     pa.array(np.repeat(np.array(sizes, np.int64), reps)),
                     *[pa.array(np.ascontiguousarray(odd[:, k])) for k in range(WORDS)]],
                    ["token", "at", "node", "label", "n", *[f"w{k}" for k in range(WORDS)]],
                )
    return run


def _prefix_pairs(prefix: DataFrame, percent: int) -> DataFrame:
    """``a`` < ``b``: distinct pairs of nodes with different labels that share
    a prefix shingle and pass the filters on sizes, places and bitmaps."""
    def side(rows: DataFrame, x: str) -> DataFrame:
        keys = ("token", "cx", "cy", "salt")
        return rows.select(*[c for c in keys if c in rows.columns], *[
            F.col(c).alias(x if c == "node" else f"{c}{x}") for c in prefix.columns if c != "token"
        ])

    differ = sum((F.bit_count(F.col(f"w{k}a").bitwiseXOR(F.col(f"w{k}b"))) for k in range(WORDS)), F.lit(0))
    reach = F.least("ata", "atb") + F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))  # of the intersection

    def passed(pairs: DataFrame) -> DataFrame:
        return (
            pairs.filter("labela != labelb")
            .filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
            .filter(reach * (100 + percent) >= percent * (F.col("na") + F.col("nb")))
            .filter(differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        )

    hot = stored(prefix.groupBy("token").count().filter(F.col("count") > HOT).select("token"), "near-hot")
    if hot.isEmpty():
        return passed(side(prefix, "a").join(side(prefix, "b"), "token").filter("a < b")).distinct()
    light = prefix.join(small(hot), "token", "left_anti")
    pairs = passed(side(light, "a").join(side(light, "b"), "token").filter("a < b"))

    schema = f"{', '.join(f'{c} long' for c in prefix.columns)}, cx long, cy long, big boolean"
    roles = prefix.join(small(hot), "token", "left_semi").select(*prefix.columns).mapInArrow(_roles(percent), schema)
    roles = stored(roles, "near-roles")
    key = ["token", "cx", "cy"]
    sides = roles.groupBy(*key).agg(F.count_if("big").alias("nx"), F.count_if(~F.col("big")).alias("ny"))
    sides = sides.filter("nx > 0 and ny > 0 and (cx != cy or nx > 1)").withColumn("salts", F.ceil(F.col("nx") / DEALT))
    sides = small(stored(sides, "near-sides"))
    kept = roles.join(sides.select(*key, "salts"), key)
    one = kept.filter("big").withColumn("salt", F.pmod(F.xxhash64("node"), "salts"))
    two = kept.filter("not big").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    met = side(one, "a").join(side(two, "b"), [*key, "salt"]).filter("a != b and (cx != cy or a < b)")
    return pairs.unionByName(passed(met)).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """A row per row of ``docs`` (``doc_id``, ``text``; other columns are
    ignored): ``doc_id``, ``n_shingles``, ``component_id`` (smallest doc_id
    reachable over links of at least ``percent`` % set similarity, itself
    included) and ``kept``.

    Null or wordless texts: 0 shingles, linked with nothing, kept.  Rows
    without a doc_id: linked with nothing, component_id null, kept.
    Repeated doc_ids: each text counts, and all rows of one doc_id and text
    get the same result.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = source.withColumn("th", F.xxhash64("text"))
    signed = stored(
        source.mapInArrow(
            _signatures(width, band_rows(percent / 100)), "doc_id long, th long, n_shingles long, fp binary, bands array<long>"
        ),
        "near-signed",
    )
    # a class per distinct set; struct(doc_id, th) names one of its texts
    classes = (
        signed.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("fp").agg(F.min(F.struct("doc_id", "th", "bands")).alias("rep"))
        .select("fp", "rep.*", F.monotonically_increasing_id().alias("node"))
    )
    classes = stored(classes, "near-classes")
    bands = classes.select("node", F.posexplode("bands").alias("band", "key"))
    order = F.xxhash64("node", F.col("band") % CENTRE_ORDERS)
    shared = bands.groupBy("key").agg(F.count("*").alias("m"), F.min_by("node", order).alias("a")).filter("m > 1")
    members = stored(bands.join(shared.select("key", "a"), "key").select("key", "node", "a"), "near-members")

    chosen = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "th")
    chosen = small(stored(chosen, "near-chosen"))
    texts = stored(
        source.join(chosen, ["doc_id", "th"]).select("node", "text").dropDuplicates(["node"]), "near-texts"
    )

    confirm = _confirmed(width, percent)

    def check(pairs: DataFrame, name: str) -> DataFrame:
        return stored(
            pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            .mapInArrow(confirm, "a long, b long"), name,
        )

    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    star = stored(
        members.withColumnRenamed("node", "b").filter("a != b").select(*pair).distinct(), "near-star"
    )
    linked = check(star, "near-linked")
    labels = components(linked, "a", "b")

    # members, other than its centre, of a bucket over several components
    rest = (
        members.filter("a != node").join(labels, "node", "left")
        .select("key", "node", F.coalesce("label", "node").alias("label"))
    )
    rest = stored(rest, "near-rest")
    split = rest.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y")
    rest = stored(
        rest.join(split.select("key"), "key").groupBy("node").agg(F.first("label").alias("label")), "near-rest"
    )
    if not rest.isEmpty():
        left = texts.join(rest, "node").select("node", "label", "text")
        seen = stored(
            left.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("text")
            .mapInArrow(_tokens(width), "token long").groupBy("token").count().filter("count > 1"), "near-frequent"
        )
        frequent = {r["token"]: r["count"] for r in seen.orderBy(F.desc("count"), "token").limit(FREQUENT).collect()}
        wide = ", ".join(f"w{k} long" for k in range(WORDS))
        prefix = stored(
            left.mapInArrow(_prefix(width, percent, frequent), f"token long, at long, node long, label long, n long, {wide}"), "near-prefix"
        )
        more = _prefix_pairs(prefix, percent).join(star, ["a", "b"], "left_anti")
        more = stored(more, "near-pairs")
        labels = components(linked.union(check(more, "near-linked")), "a", "b")

    named = (
        classes.select("fp", "node", "doc_id").join(labels, "node", "left")
        .select("fp", "doc_id", F.coalesce("label", "node").alias("label"))
    )
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = stored(named.join(smallest, "label").select("fp", "component_id"), "near-named")
    return (
        signed.select("doc_id", "n_shingles", "fp").join(small(named), "fp", "left")
        .select(
            "doc_id", "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near copies
    (the smallest doc_id), columns unchanged.  Of repeated rows with one
    doc_id one stays; rows without a doc_id stay."""
    found = stored(near_duplicates(docs, width, percent), "near-found")
    gone = stored(found.filter("not kept").select("doc_id").distinct(), "near-gone")
    left = docs.join(small(gone), "doc_id", "left_anti")
    if found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return left.select(*docs.columns)
    named = left.filter("doc_id is not null").dropDuplicates(["doc_id"])
    return named.unionByName(left.filter("doc_id is null")).select(*docs.columns)


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one row of each group of near copies, columns
    unchanged.  Each text is judged by itself, whatever ids it stands under:
    of a group the text with the smallest doc_id stays (then the smallest
    hash; rows without a doc_id come last), so an id keeps all its texts that
    are copies of no other.

    Of rows with one doc_id and text one stays, the first by its other
    columns.  Wordless and null texts are copies of nothing; without a doc_id
    their rows all stay.
    """
    source = docs.withColumn("__near_th", F.xxhash64(F.col("text").cast("string")))
    pairs = stored(
        source.groupBy("doc_id", F.col("__near_th").alias("th")).agg(F.count("*").alias("c")), "near-ids"
    )
    judged = source.select(F.col("__near_th").alias("doc_id"), "text")
    found = near_duplicates(judged, width, percent).filter("n_shingles > 0")
    found = found.select(F.col("doc_id").alias("th"), "component_id").distinct()
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    texts = pairs.groupBy("th").agg(F.min(place).alias("first"), F.sum("c").alias("c")).join(found, "th")
    texts = stored(texts, "near-texts")
    best = texts.groupBy("component_id").agg(F.min(F.struct("first", "th")).alias("best")).select("best.th")
    texts = texts.join(best.withColumn("stays", F.lit(True)), "th", "left")
    marks = stored(texts.filter("stays is null or c > 1").select(
        F.col("th").alias("__near_th"), F.col("first.id").alias("__near_id"), F.col("stays").isNotNull().alias("__near_stays")
    ), "near-marks")
    left = source.join(small(marks), "__near_th", "left").filter(
        F.col("__near_stays").isNull() | (F.col("__near_stays") & F.col("doc_id").eqNullSafe(F.col("__near_id")))
    ).select(*docs.columns, "__near_th")

    twice = pairs.filter("c > 1").join(texts.select("th", F.lit(True).alias("words")), "th", "left")
    twice = twice.filter("words or doc_id is not null").select(F.col("doc_id").alias("__near_id"), F.col("th").alias("__near_t"))
    twice = stored(twice, "near-repeated")
    if twice.isEmpty():
        return left.select(*docs.columns)
    same = F.col("doc_id").eqNullSafe(F.col("__near_id")) & (F.col("__near_th") == F.col("__near_t"))
    others = F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("__near_0")))
    one = left.join(small(twice), same, "left_semi").groupBy("doc_id", "__near_th").agg(
        F.min_by(F.struct(*docs.columns), others).alias("__near_row")
    )
    return left.join(small(twice), same, "left_anti").select(*docs.columns).unionByName(one.select("__near_row.*"))
