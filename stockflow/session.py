"""SparkSession construction and session-level helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC dates, ANSI arithmetic, adaptive execution
# (runtime broadcast conversion, partition coalescing, skew-join splitting).
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Lets a (sku_id, date) join and sku_id windows reuse one hash partitioning.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.ui.enabled": "false",
    # Jobs started at the same time (cross-validation folds) share the executors.
    "spark.scheduler.mode": "FAIR",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "stockflow", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; size
    ``shuffle_partitions`` to the data (≈ input bytes / 128 MB), AQE coalesces.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in SESSION_DEFAULTS.items():
        b = b.config(k, v)
    if master and master.startswith("local"):
        # Local mode: the driver JVM is the only executor (ignored if a JVM
        # is already running).
        b = b.config("spark.driver.memory", "8g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder.

    A cluster names its shared folder in ``spark.checkpoint.dir``; that value is
    always used. Only when it is unset in local mode (tests) a fresh scratch
    folder is created and registered; on a cluster a machine-local folder would
    be lost to the other machines, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="stockflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table under the session's checkpoint
    folder (shared storage on a cluster) and return the scan of it.

    This cuts the lineage like ``checkpoint()`` but keeps the data columnar:
    later reads get column pruning and row-group pruning on pushed filters.
    """
    path = scratch_table_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A fresh table folder under the session's checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
