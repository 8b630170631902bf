"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that hold at any scale; the cluster's own values win where they are set.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Arrow batches by size: packs and images are big rows
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
    "spark.ui.enabled": "false",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cellselect")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators count on, for a session made elsewhere; what it has set stays."""
    given = spark.conf.getAll
    for key in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
                "spark.sql.adaptive.forceOptimizeSkewedJoin", "spark.sql.execution.arrow.maxBytesPerBatch"):
        if key not in given:
            spark.conf.set(key, DEFAULTS[key])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only a local session without one gets a
    new folder of this machine, removed at exit; elsewhere the setting is needed."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder. The caller owns what it writes there; the folder of a local
    session goes at exit, a cluster's is cleared by its owner's rule."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
