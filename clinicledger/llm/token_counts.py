"""Operator 5: exact token counts for every context limit.

Documents are counted by encoded length (an exact histogram; the text itself
isn't shuffled).  Suffix sums over the lengths then answer, for a limit L:
how many documents are at least so long, all tokens, the tokens left when
every document is cut to L, and the share of documents up to L.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinicledger.llm.common import stored
from clinicledger.llm.encoder import encoder
from clinicledger.llm.shingles import batches_by_bytes

#: lengths summed by one task; their blocks are summed afterwards
BLOCK = 4096


def _count(path: str | None, by: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for batch in batches_by_bytes(whole, "text"):
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in by), pa.array(enc.lengths(batch.column("text")))], [*by, "length"]
                )
    return run


def length_histogram(docs: DataFrame, by: Sequence[str] = (), tokenizer: str | None = None) -> DataFrame:
    """``by`` columns, ``length``, ``n_docs``: documents by number of ids of
    their whole text.  Null and empty texts have length 0; a null ``by``
    value is a group; repeated rows all count; an empty table gives no row."""
    clash = {"text", "length", "n_docs"} & set(by)
    if clash:
        raise ValueError(f"reserved column names: {sorted(clash)}")
    rows = docs.select(*by, F.col("text").cast("string").alias("text"))
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by), "length long"])
    return rows.mapInArrow(_count(tokenizer, by), schema).groupBy(*by, "length").agg(F.count("*").alias("n_docs"))


#: names that ``context_table`` gives
OUTPUT = ("length", "n_docs", "docs_to", "docs_from", "tokens_to", "tokens_total", "tokens_cut", "share_to")


def context_table(histogram: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For every length that occurs, taken as a context limit: ``length``,
    ``n_docs`` of that length, ``docs_to`` (up to it), ``docs_from`` (at
    least it), ``tokens_to``, ``tokens_total``, ``tokens_cut`` (left when
    each document is cut to it) and ``share_to``.  Sums run within blocks of
    lengths first; a second window carries one row per block.  ``by`` columns
    may have any name but these."""
    clash = set(OUTPUT) & set(by)
    if clash:
        raise ValueError(f"reserved column names: {sorted(clash)}")
    names, by = list(by), [f"__by_{k}" for k in range(len(by))]
    histogram = histogram.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, by)], "length", "n_docs")
    h = stored(histogram.withColumn("block", F.floor(F.col("length") / BLOCK)), "lengths")
    tokens = F.col("length") * F.col("n_docs")
    blocks = h.groupBy(*by, "block").agg(F.sum("n_docs").alias("bd"), F.sum(tokens).alias("bt"))
    group = Window.partitionBy(*by)
    before = group.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("block").alias("_block"),
        F.coalesce(F.sum("bd").over(before), F.lit(0)).alias("d0"),
        F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("t0"),
        F.sum("bd").over(group).alias("docs_total"), F.sum("bt").over(group).alias("tokens_total"),
    )
    on = F.col("block") == F.col("_block")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    here = Window.partitionBy(*by, "block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    summed = h.withColumn("d", F.sum("n_docs").over(here)).withColumn("t", F.sum(tokens).over(here))
    out = summed.join(blocks, on).withColumn("docs_to", F.col("d") + F.col("d0"))
    out = out.withColumn("tokens_to", F.col("t") + F.col("t0"))
    out = out.withColumn("docs_from", F.col("docs_total") - F.col("docs_to") + F.col("n_docs"))
    return out.select(
        *[F.col(k).alias(c) for c, k in zip(names, by)], "length", "n_docs", "docs_to", "docs_from", "tokens_to", "tokens_total",
        (F.col("tokens_to") + F.col("length") * (F.col("docs_total") - F.col("docs_to"))).alias("tokens_cut"),
        (F.col("docs_to") / F.col("docs_total")).alias("share_to"),
    )


def quantile(table: DataFrame, share: float, by: Sequence[str] = ()) -> DataFrame:
    """The smallest length that covers ``share`` of the documents."""
    return table.filter(F.col("share_to") >= share).groupBy(*by).agg(F.min("length").alias("length"))


def truncated_total(table: DataFrame, limit: int, by: Sequence[str] = ()) -> DataFrame:
    """Tokens left when every document is cut to ``limit``, any limit: all of
    the documents up to it, and ``limit`` of each longer one."""
    longer = F.sum(F.when(F.col("length") > limit, F.col("n_docs")).otherwise(0))
    upto = F.sum(F.when(F.col("length") <= limit, F.col("length") * F.col("n_docs")).otherwise(0))
    return table.groupBy(*by).agg((upto + limit * longer).alias("tokens"))
