"""Session settings the library relies on.

Timestamps are UTC wall-clock values of type TIMESTAMP_NTZ everywhere.  The session zone is pinned to UTC so
that the few functions which only exist for TIMESTAMP convert without a shift.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime settings that are safe to set on a session somebody else created.
RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a range split of a skewed shuffle is also wanted for rebalances in front of writes
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # batches of whole texts for Python stay small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # `row_number() <= k` is cut before the shuffle up to this k (60 snapshots, 300 terms, 3000 URLs, ...)
    "spark.sql.optimizer.windowGroupLimitThreshold": "20000",
}

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pin_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a given session and return it."""
    for key, value in RUNTIME_DEFAULTS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "pressdelta", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """Session for scripts and tests.  On a cluster pass no master: spark-submit decides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_DEFAULTS, "spark.sql.streaming.stateStore.providerClass": STATE_STORE, **(conf or {})}.items():
        builder = builder.config(key, value)
    return pin_session(builder.getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints: the one the cluster names, or a scratch folder when none is set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    # sc.getConf: a core setting, not visible to every session's runtime conf
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="pressdelta-checkpoint-")
    sc.setCheckpointDir(named)
    return named
