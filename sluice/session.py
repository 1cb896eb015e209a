"""Session construction and scratch locations.

Everything that needs durable intermediate storage (snapshots, stream
checkpoints, landed files) goes under ``spark.checkpoint.dir``; a default is
set only when the session has none, as in tests.
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators rely on for exact results.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # Pagination parameters overwrite configured ones.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Python workers get batches bounded in bytes, whatever the length of a row's texts.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 * 1024 * 1024),
}

SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Broadcast only what the planner has measured to be small.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def get_session(master: str | None = None, partitions: int | None = None,
                app: str = "sluice") -> SparkSession:
    """Build (or reuse) a session with the settings the library needs."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in {**SCALE_CONF, **REQUIRED_CONF}.items():
        b = b.config(k, v)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    b = b.config("spark.driver.memory", os.environ.get("SLUICE_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session settings the operators need to an existing session."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder. Where it is unset a local one is
    made in local mode only; on a cluster that is an error, since executors
    and driver would write to disks of their own."""
    d = spark.conf.get("spark.checkpoint.dir", None) or _context_dir(spark)
    if not d and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="sluice-ckpt-")      # local mode; the context remembers it from here on
    if not _context_dir(spark):
        spark.sparkContext.setCheckpointDir(d)
    return d


def _context_dir(spark: SparkSession) -> str | None:
    """The context's checkpoint folder. The context makes one of its own inside the folder it is given; that serves as well."""
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint dir."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
