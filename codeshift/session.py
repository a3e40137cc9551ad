"""Spark session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Configuration that every job in this package assumes.  AQE is what turns the
# plain joins below into broadcast joins when the runtime size of one side is
# small (a checked broadcast with sort-merge as the fallback) and what splits
# skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join also where a later step groups by the same key: the
    # extra shuffle it needs is planned only when there is skew.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    # Per-pair work (distances, line profiles) is CPU-heavy and small in
    # bytes: do not let AQE coalesce a small shuffle into one or two tasks.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Long code texts: keep Arrow batches modest so one UDF batch stays small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Python call-site capture on every DataFrame API call (for error
    # messages) costs more than the JVM round trip itself on wide plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# Only applied when this module starts the JVM (local runs: tests, bench).
LOCAL_DRIVER_MEMORY = "8g"


def build_session(master: str | None = None, app_name: str = "codeshift",
                  shuffle_partitions: int | None = None,
                  extra_conf: dict | None = None) -> SparkSession:
    """Create (or get) a session with the package defaults.

    ``master`` is only set when given; on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", LOCAL_DRIVER_MEMORY)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext, or None where the session has none (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:
        return None


def _configured_checkpoint_dir(spark: SparkSession) -> str | None:
    sc = _context(spark)
    if sc is not None:
        try:
            d = sc.getCheckpointDir()
        except Exception:  # older API
            d = None
        if d:
            return d
        d = sc.getConf().get("spark.checkpoint.dir", None)
        if d:
            return d
    try:
        return spark.conf.get("spark.checkpoint.dir")
    except Exception:
        return None


def _master(spark: SparkSession) -> str:
    sc = _context(spark)
    if sc is not None:
        return sc.master or ""
    try:
        return spark.conf.get("spark.master")
    except Exception:
        return ""


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only when it is unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  Only a local-mode session (tests, the bench) without the setting gets
    a fresh folder under the system temp directory.
    """
    sc = _context(spark)
    d = _configured_checkpoint_dir(spark)
    if d:
        try:
            if sc is not None and not sc.getCheckpointDir():
                sc.setCheckpointDir(d)
        except Exception:
            pass
        return d
    if not _master(spark).startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; configure a shared folder for the cluster")
    d = tempfile.mkdtemp(prefix="codeshift-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(d)
    spark.conf.set("spark.checkpoint.dir", d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/codeshift-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str):
    """Write ``df`` as parquet below the shared checkpoint folder and read it
    back: a stage boundary that cuts the lineage (a lost executor does not
    recompute the stage) and lets later jobs prune columns."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# A side of a join is broadcast only when its written size is below this.
BROADCAST_LIMIT = 16 << 20


def checked_broadcast(df, limit: int = BROADCAST_LIMIT):
    """``df`` with a broadcast hint when the size the optimizer knows for it is
    at most ``limit`` bytes, else ``df`` as it is (a shuffled join).  For tables
    just written, whose size is exact."""
    from pyspark.sql import functions as F
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except Exception:  # no JVM access (e.g. Spark Connect): the engine decides
        return df
    return F.broadcast(df) if size <= limit else df


def local_path(p: str) -> str:
    """Strip a ``file:`` scheme for the few local-only helpers (tests)."""
    if p.startswith("file:"):
        p = p[5:]
        while p.startswith("//"):
            p = p[1:]
    return os.path.abspath(p)
