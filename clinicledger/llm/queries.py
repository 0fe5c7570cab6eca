"""Registered queries of the training-data operators and their DuckDB SQL.

Each query applies its operator with production parameters to its whole
table.  Operators that SQL can't express (a fitted model, a tokenizer's ids,
keyed pseudonyms, voted line templates) have no SQL; ``tests/llm`` holds them
against brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clinicledger.llm import alignment, decontaminate, licenses, line_templates, merkle, mixing, near_dedup, nearest, pii
from clinicledger.llm import secrets, token_counts, token_files, toxicity
from clinicledger.llm.common import scratch_path, tell_workers

#: stands in for the deployment's secret
PII_KEY = "rotate-me"
MIX_SEED = 13
END_ID = 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tell_workers(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severities(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), folder, END_ID)
    return token_files.read_digests(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_table(token_counts.length_histogram(_table(spark, sf_dir, "documents"), ["source"]), ["source"])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return line_templates.drop_recurring_lines(docs, min_tokens=1, several=True).select("doc_id", "text", "n_lines", "n_dropped")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "n_pii", "pii_kinds")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(_table(spark, sf_dir, "documents"), seed=MIX_SEED)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors.filter("vec_id % 50 = 0"), vectors)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(_table(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_near_dedup, op3_toxicity, op4_token_files, op5_token_counts, op6_line_dedup,
        op7_license_scan, op8_pii, op9_mixing, op10_nearest, op11_alignment, op12_secrets, op13_merkle,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"


def _shingle_sql(table: str, key: str, pattern: str, width: int) -> str:
    """Distinct shingles of a table's texts: {key}, g."""
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) END) AS g
        FROM (SELECT {key}, regexp_extract_all({_LOWER}, '{pattern}') AS w FROM {table})"""


ORACLES: dict[str, str] = {
    "op1_decontaminate": f"""
WITH i AS ({_shingle_sql("benchmark", "item_id", _ALNUM, 5)}),
d AS ({_shingle_sql("documents", "doc_id", _ALNUM, 5)}),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared::DOUBLE / n_item AS containment
FROM s JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
""",
    "op2_near_dedup": f"""
WITH RECURSIVE d AS ({_shingle_sql("documents", "doc_id", _SPACED, 3)}),
n AS (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN d USING (doc_id) GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM d a JOIN d b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS low FROM n UNION SELECT e.y, r.low FROM r JOIN e ON e.x = r.doc_id WHERE r.low < e.y)
SELECT n.doc_id, n.n AS n_shingles, min(r.low) AS component_id, n.doc_id = min(r.low) AS kept
FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n
""",
    "op9_mixing": mixing.REPLICATE_SQL.format(docs="documents", seed=MIX_SEED),
    "op10_nearest": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS len FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
  list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) / (q.len * c.len) AS score
  FROM l q JOIN l c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
""",
    "op13_merkle": merkle.AUDIT_SQL,
}
