"""SparkSession construction with the settings the reports are tuned for."""

from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import SparkSession

# Settings every report relies on. AQE re-plans joins from runtime sizes
# (broadcast demotion/promotion, skew-join splitting, partition coalescing).
_BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join partition even where a later operator needs the join's
    # partitioning (AQE then adds the shuffle it takes)
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Joins keyed (visit, procedure) may reuse a partitioning on visit alone.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # no call site is sent to the JVM with every column expression: building the
    # encounter report's plan took 2.4 s with them and 1.1 s without
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "clinicledger",
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session configured for the billing reports.

    ``master`` and ``shuffle_partitions`` are only applied when given (tests
    and local benches); on a cluster the submitter's settings win, including
    ``spark.checkpoint.dir``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        # one host: bucketed scans' preferred locations never match the local
        # executor, so waiting for locality only delays tasks
        conf.setdefault("spark.locality.wait", "0")
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def join_in_place(spark: SparkSession) -> None:
    """Let a session made elsewhere join (visit, line) on the layout's buckets
    of the line alone, as ``get_spark`` does: by Spark's default both tables
    are shuffled whole."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    spark.conf.set(key, _BASE_CONF[key])


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries planned inside leave no shuffle files when they end. By default
    these stay until the driver happens to collect its garbage, so that the
    files of one write lie beside those of all before."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)


#: for a folder written by several jobs: none marks it as complete by itself
UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def mark_complete(spark: SparkSession, folder: str) -> None:
    """Give ``folder`` the success file of a finished write."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hpath, True).close()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory the cluster names in
    ``spark.checkpoint.dir``. Only a local master may leave it unset and gets
    a scratch directory; executors on other machines couldn't see one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
    local = tempfile.mkdtemp(prefix="clinicledger-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local
