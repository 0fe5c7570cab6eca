"""Operator 9: mix sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the rows divided by
its share now.  Each document draws a uniform number from a seeded hash of its
id and text, which is put through the inverse Poisson distribution of its
source; the document is exploded to so many copies, and all copies are
shuffled by a second seeded hash.  The same seed gives the same rows, also
when a task is repeated.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinicledger.llm.common import small, stored


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) with 48 random bits from a hash of the parts."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("bigint") / F.lit(float(2**48))


def cumulative(rate: Column) -> Column:
    """P(count <= 0), P(count <= 1), ... of a Poisson distribution, up to
    where the rest is below 1e-16; summed from logarithms, so that large
    rates don't underflow."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    # in slices of about sqrt(top) counts, so that no long array is copied for
    # each count; sums and logarithms go on from slice to slice
    width = F.ceil(F.sqrt(top)).cast("int")
    step = lambda s, k: F.struct(
        (s.log + F.log(rate) - F.log(k.cast("double"))).alias("log"),
        (s.sum + F.exp(s.log + F.log(rate) - F.log(k.cast("double")))).alias("sum"),
        F.concat(s.sums, F.array(s.sum + F.exp(s.log + F.log(rate) - F.log(k.cast("double"))))).alias("sums"),
    )
    none = F.array().cast("array<double>")

    def slice_(s: Column, first: Column) -> Column:
        inner = F.aggregate(
            F.sequence(first, F.least(first + width - 1, top)),
            F.struct(s.log.alias("log"), s.sum.alias("sum"), none.alias("sums")), step,
        )
        return F.transform(F.array(inner), lambda n: F.struct(
            n.log.alias("log"), n.sum.alias("sum"), F.concat(s.slices, F.array(n.sums)).alias("slices")
        ))[0]

    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.array(F.exp(-rate))).alias("slices"))
    sums = F.aggregate(F.sequence(F.lit(1), top, width), start, slice_, lambda s: F.flatten(s.slices))
    return F.when(rate > 0, sums).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, by: str = "source") -> DataFrame:
    """``__mix_source``, ``rate``, ``sums`` for every value of ``by`` (null is a
    value).  Without weights all values weigh the same; with them, a value
    that has none weighs 0.  Weights are shares of the row total."""
    counts = stored(docs.groupBy(F.col(by).alias("__mix_source")).agg(F.count("*").alias("n")), "sources")
    if weights is None:
        weighted = counts.withColumn("weight", F.lit(1.0))
    else:
        if any(w < 0 for w in weights.values()) or not sum(weights.values()) > 0:
            raise ValueError("weights are not negative and their sum is positive")
        given = docs.sparkSession.createDataFrame(list(weights.items()), "_s string, weight double")
        weighted = counts.join(F.broadcast(given), F.col("__mix_source").cast("string").eqNullSafe(F.col("_s")), "left")
        weighted = weighted.select("__mix_source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = weighted.agg(F.sum("n").alias("total"), F.sum("weight").alias("weights"))
    rate = F.when(F.col("weights") > 0, F.col("weight") * F.col("total") / (F.col("weights") * F.col("n"))).otherwise(0.0)
    return weighted.crossJoin(F.broadcast(total)).select("__mix_source", rate.alias("rate")).withColumn(  # a one-row side
        "sums", cumulative(F.col("rate"))
    )


def replicate(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, seed: int = 13, by: str = "source"
) -> DataFrame:
    """``docs`` with each row as many times as its draw says (0 included) and
    ``copy`` (from 1), in globally shuffled order.

    Rows with equal doc_id and text draw equally; null ids and texts count as
    empty.  An empty table stays empty.  An input column ``copy`` is replaced.
    """
    table = rates(docs, weights, by).withColumnsRenamed({"rate": "__mix_rate", "sums": "__mix_sums"})
    table = small(stored(table, "rates"), 10_000)
    names = [c for c in docs.columns if c != "copy"]
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    drawn = docs.select(*names).withColumn("__mix_text", text).join(table, F.col(by).eqNullSafe(F.col("__mix_source")))
    drawn = drawn.withColumn("__mix_u", uniform(seed, F.col("doc_id"), F.col("__mix_text")))
    drawn = drawn.withColumn("__mix_count", F.size(F.filter("__mix_sums", lambda c: c <= F.col("__mix_u"))))
    copies = drawn.filter("__mix_count > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__mix_count"))))
    order = F.xxhash64(F.lit(seed), "doc_id", "__mix_text", "copy")
    return copies.withColumn("__mix_order", order).repartition("__mix_order").sortWithinPartitions("__mix_order").select(*names, "copy")


#: DuckDB SQL for ``replicate`` over a relation {docs}, seed {seed}
REPLICATE_SQL = """
WITH d AS (SELECT * FROM {docs}),
n AS (SELECT source, count(*) AS n FROM d GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM n)::DOUBLE / ((SELECT count(*) FROM n)::DOUBLE * n) AS rate FROM n),
k AS (SELECT source, rate, unnest(range(0, (ceil(rate + 12 * sqrt(rate) + 30))::BIGINT + 1)) AS k FROM r),
c AS (SELECT source, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS s FROM k),
u AS (SELECT *, ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 12))::BIGINT / 281474976710656.0 AS u FROM d),
g AS (SELECT source, list(s ORDER BY s) AS sums FROM c GROUP BY source),
m AS (SELECT u.*, len(list_filter(g.sums, lambda x: x <= u.u)) AS n FROM u JOIN g ON u.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INTEGER AS copy FROM m
"""
