"""Helpers shared by the training-data operators: written intermediate
tables in the cluster's shared folder and size-checked broadcasts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinicledger.session import ensure_checkpoint_dir

#: Rows and bytes of a table that may be broadcast (its hash table takes about
#: 100 MB at most); a larger side is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 48 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: rows per Arrow batch, where the session has Spark's default of 10,000:
#: texts have kilobytes, so that would be tens of MB in each worker and task
BATCH_ROWS = 1_000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tell_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it,
    whatever folder they start in (a cluster ships it as usual), and keep
    their Arrow batches small."""
    if spark.conf.get(_BATCH_CONF) == "10000":
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir`` (shared by the cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later
    steps and lost executors start from the files, not from the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _value_bytes(field) -> F.Column:
    """Bytes of a column's value, near enough to bound a table."""
    kind = field.dataType.typeName()
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
    if kind in ("array", "map", "struct"):
        return F.coalesce(F.octet_length(F.col(f"`{field.name}`").cast("string")), F.lit(0))
    return F.lit(8)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows of ``most``
    bytes in all, else unchanged (shuffle join).  Measures ``df``, so pass a
    written table."""
    size = sum((_value_bytes(f) for f in df.schema.fields), F.lit(0)).cast("long")
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= most else df


def ascii_lower(col):
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, _UPPER, _UPPER.lower())
