"""Spark session defaults and the shared checkpoint folder.

The library never creates its own session on a cluster: callers pass the
session they have.  ``get_session`` is for tests, the bench and local use.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators are written against.  AQE re-plans joins at run time
# from real shuffle sizes (broadcast only when the measured side is under
# ``autoBroadcastJoinThreshold``, sort-merge otherwise), splits skewed join
# partitions and coalesces small ones.  Wide rows with long ids take under 60% of the
# shuffle bytes under zstd that they take under lz4 (a core setting: it counts
# only where the session begins, so a cluster's own session has to name it).
SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.io.compression.codec": "zstd",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "keelson") -> SparkSession:
    """Local/test session with the library defaults and the UI off."""
    master = master or os.environ.get("KEELSON_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("KEELSON_DRIVER_MEMORY", "16g"))
    )
    if master.startswith("local"):
        builder = builder.config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="keelson-wh-"))
    for k, v in SCALE_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the deployment (a shared file system); a
    local master alone gets a folder of its own when it is unset.  Run folders
    inside it carry a random name and stay until the deployment clears them.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    local = tempfile.mkdtemp(prefix="keelson-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name


def cut_lineage(df):
    """Reliable checkpoint of ``df`` into the shared folder named by ``spark.checkpoint.dir``.

    Later stages then recompute from the checkpoint, not from the sources,
    when an executor is lost.  (Never ``localCheckpoint``: it keeps blocks on
    executors that may disappear.)
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
