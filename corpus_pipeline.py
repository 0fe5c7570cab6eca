"""The corpus pipeline: five stages over ``documents``, each written as
Parquet and read again before the next.

1. toxicity: documents graded toxic go;
2. near duplicates: one document of each group stays (five-word shingles, 0.8),
   each text judged by itself, with or without a doc_id;
3. decontamination: documents that contain a benchmark item go;
4. mixing: documents are repeated so that all sources weigh the same;
5. token files: the rest as flat binary token ids, read back as a table.

All stages but the last return the columns of ``documents``.  Rows are judged
by their text, so rows without a text pass the filters, and rows without a
doc_id are filtered like any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clinicledger.llm import decontaminate, mixing, near_dedup, token_files, toxicity
from clinicledger.llm.common import scratch_path, tell_workers
from clinicledger.llm.queries import END_ID, MIX_SEED


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tell_workers(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tell_workers(spark)
    return near_dedup.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.replicate(docs, seed=MIX_SEED).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document
    in the files, read back."""
    tell_workers(spark)
    folder = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, folder, END_ID)
    return token_files.read_digests(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: a fitted model and a tokenizer's ids can't be told in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the cluster's
    shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
