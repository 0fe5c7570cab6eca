"""Order-insensitive comparison of a Spark result with a DuckDB result.

Mirrors the correctness gate: same column names, same row count, same
multiset of rows (values normalised: decimals by value, timestamps and dates
by ISO text, floats to 15 significant digits).
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib

import duckdb

TEST_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck_connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TEST_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        return ("n", str(v.normalize()) if v == v else "nan")
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("n", str(decimal.Decimal(v).normalize()))
    if isinstance(v, float):
        if v != v:
            return None
        return ("f", f"{v:.15g}")
    if isinstance(v, dt.datetime):
        return ("t", v.isoformat())
    if isinstance(v, dt.date):
        return ("d", v.isoformat())
    return ("s", str(v))


def rows_digest(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    normed = [tuple(_norm(r[i]) for i in order) for r in rows]
    normed.sort(key=lambda t: tuple((x is not None, x) for x in t))
    return [columns[i] for i in order], normed


def compare(spark_df, con, sql: str) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_rows = rel.fetchall()
    sc, sn = rows_digest(s_cols, s_rows)
    dc, dn = rows_digest(d_cols, d_rows)
    out = {
        "spark_rows": len(s_rows),
        "oracle_rows": len(d_rows),
        "columns_match": sc == dc,
        "rows_match": len(s_rows) == len(d_rows),
        "values_match": sn == dn,
        "spark_hash": hashlib.sha1(repr(sn).encode()).hexdigest()[:12],
        "oracle_hash": hashlib.sha1(repr(dn).encode()).hexdigest()[:12],
    }
    if not out["columns_match"]:
        out["spark_columns"] = sc
        out["oracle_columns"] = dc
    elif not out["values_match"]:
        s_set, d_set = set(sn), set(dn)
        out["only_spark"] = [dict(zip(sc, r)) for r in list(s_set - d_set)[:3]]
        out["only_oracle"] = [dict(zip(dc, r)) for r in list(d_set - s_set)[:3]]
    return out
