"""Joins of fact tables on keys that may hold a large share of the rows.

The layout's fact tables are joined in place on their buckets, which Spark
can't split.  ``heavy_summary`` finds, once per stored version, the lines,
transactions, visit transactions and visits that more rows refer to than a
bucket should hold; their number is bounded by the bucket count.  Rows of a
bucketed table under such keys are stored apart, as plain files that split
like any.  Joins then go two ways: all other keys in place, the heavy ones
against a broadcast of the few rows that have them, and both are unioned.
Without heavy keys the plan is the plain join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinicledger.sources.tables import Tables

LINE, TRANSACTION, VISIT_TRANSACTION, VISIT = (
    "patient_visit_procs_id", "transactions_id", "visit_transactions_id", "patient_visit_id",
)
# columns whose values the joins gather in one place, by key
REFERENCES: dict[str, tuple[str, ...]] = {
    LINE: ("transaction_distributions",),
    TRANSACTION: ("transaction_distributions",),
    VISIT_TRANSACTION: ("transactions",),
    VISIT: ("patient_visit_procs", "patient_visit_resource", "visit_transactions"),
}
# bucketed tables that may have many rows of one bucket key
SPLIT_TABLES: dict[str, str] = {"transaction_distributions": LINE, "patient_visit_resource": VISIT}
# fewer rows than this are no burden for a task
LEAST_ROWS = 100_000
# broadcast rows of the other side of a heavy join; salts beyond it
BROADCAST_ROWS = 1_000_000
SALTS = 64


def heavy_values(parts: Sequence[DataFrame], columns: Sequence[str], share: int, least: int = LEAST_ROWS) -> dict[str, list[int]]:
    """Per column the values with more rows than ``least`` and than one
    ``share``-th of all (so fewer than ``share`` values), exactly. ``parts``
    together are the rows. Rows are counted by hash cell first, all columns in
    one pass over each part; only cells with that many rows are counted by
    value, so no whole column is shuffled."""
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * share))
    totals = dict.fromkeys(columns, 0)
    full: dict[str, dict[int, list[int]]] = {c: {} for c in columns}  # column, cell: its rows in each part
    for part in parts:
        cells = part.select(F.inline(F.array(*[
            F.struct(F.lit(k).alias("which"), F.when(F.col(c).isNotNull(), cell(c)).alias("cell")) for k, c in enumerate(columns)
        ]))).filter(F.col("cell").isNotNull()).groupBy("which", "cell").agg(F.count(F.lit(1)).alias("n"))
        # a value of more than ``least`` rows has its share of them in one part
        many = F.when(F.col("n") > least // len(parts), F.struct("cell", "n"))
        for found in cells.groupBy("which").agg(F.sum("n").alias("n"), F.collect_list(many).alias("many")).collect():
            column = columns[found["which"]]
            totals[column] += found["n"]
            for at in found["many"]:
                full[column].setdefault(at["cell"], []).append(at["n"])
    heavy = {}
    for column in columns:
        bar = max(least, totals[column] // share)
        # its rows in the parts that are not listed: ``least // len(parts)`` at most in each
        likely = [c for c, n in full[column].items() if sum(n) + (len(parts) - len(n)) * (least // len(parts)) > bar]
        heavy[column] = _heavy_among(parts, column, lambda c: cell(c).isin(likely), bar) if likely else []  # noqa: B023
    return heavy


def _heavy_among(parts: Sequence[DataFrame], column: str, chosen: Callable[[str], Column], bar: int) -> list[int]:
    """Values of the chosen rows with more than ``bar`` rows in all parts."""

    def counted(wanted: Column, over: int) -> dict[int, int]:
        counts: dict[int, int] = {}
        for part in parts:
            rows = part.select(column).filter(F.col(column).isNotNull() & wanted)
            for r in rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > over).collect():
                counts[r[column]] = counts.get(r[column], 0) + r["n"]
        return counts

    # such a value has more than its share of ``bar`` in one part
    counts = counted(chosen(column), bar // len(parts))
    if len(parts) > 1 and counts:
        counts = counted(F.col(column).isin(sorted(counts)), 0)
    return sorted(v for v, n in counts.items() if n > bar)


def heavy_keys(df: DataFrame, column: str, share: int, least: int = LEAST_ROWS) -> list[int]:
    """``heavy_values`` of one column of a whole table."""
    return heavy_values([df], [column], share, least)[column]


def heavy_summary(t: Tables, share: int, least: int = LEAST_ROWS, parts: Callable[[str], int] = lambda name: 1) -> dict[str, list[int]]:
    """Heavy values of each key, with those that rows of a heavy value lead
    to: a transaction's visit transaction, a visit transaction's or a line's
    visit. At most some ``share`` values each. Each table is read once for all
    its keys, in as many shares as ``parts`` gives for it."""
    found: dict[str, set[int]] = {key: set() for key in REFERENCES}
    for name in dict.fromkeys(n for names in REFERENCES.values() for n in names):
        keys = [key for key, names in REFERENCES.items() if name in names]
        n = parts(name)
        for key, values in heavy_values([t.share(name, keys[0], k, n) for k in range(n)], keys, share, least).items():
            found[key].update(values)

    def follow(name: str, key: str, to: str) -> None:
        if found[key]:
            rows = t.table(name).filter(F.col(key).isin(sorted(found[key]))).select(to).distinct()
            found[to] |= {r[0] for r in rows.collect() if r[0] is not None}

    follow("transactions", TRANSACTION, VISIT_TRANSACTION)
    follow("visit_transactions", VISIT_TRANSACTION, VISIT)
    follow("patient_visit_procs", LINE, VISIT)
    return {key: sorted(values) for key, values in found.items() if values}


def is_heavy(t: Tables, key: str, column: str | None = None) -> Column | None:
    """Whether ``column`` holds a heavy value of ``key`` (never null); None
    without such values."""
    values = t.heavy.get(key)
    return F.coalesce(F.col(column or key).isin(values), F.lit(False)) if values else None


def _heavy_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Rows of heavy keys only: broadcast ``right`` if it is small, else deal
    ``left`` over salts and repeat ``right`` under each."""
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), list(on), how)
    spread = F.pmod(F.xxhash64(*[c for c in left.columns if c not in on] or on), F.lit(SALTS))
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return left.withColumn("_salt", spread).join(salted, [*on, "_salt"], how).drop("_salt")


def join_split(t: Tables, left: DataFrame, right: DataFrame, key: str, on: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``on`` (``key`` unless given), the
    rows of heavy values of ``key`` apart. ``how``: inner or left."""
    on = list(on) or [key]
    heavy = is_heavy(t, key)
    if heavy is None:
        return left.join(right, on, how)
    light = left.filter(~heavy).join(right, on, how)
    return light.unionByName(_heavy_join(left.filter(heavy), right.filter(heavy), on, how))


def by_parts(t: Tables, name: str, use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``use`` of table ``name``, on its rows in place and those stored apart
    (disjoint in the bucket key)."""
    light, apart = t.parts(name)
    return use(light) if apart is None else use(light).unionByName(use(apart))


def join_stored(t: Tables, name: str, shape: Callable[[DataFrame], DataFrame], right: DataFrame) -> DataFrame:
    """Table ``name`` (``shape`` applied) joined with ``right`` on its bucket
    key: the rows in place, and those stored apart against the rows of
    ``right`` under the heavy keys."""
    key = SPLIT_TABLES[name]
    light, apart = t.parts(name)
    joined = shape(light).join(right, key)
    if apart is None:
        return joined
    return joined.unionByName(_heavy_join(shape(apart), right.filter(is_heavy(t, key)), [key], "inner"))
