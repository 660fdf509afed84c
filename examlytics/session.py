"""Session construction and shared-storage locations.

Scratch tables, stream checkpoints and lineage cuts all live under the
folder the cluster names in ``spark.checkpoint.dir``.  Only when that is
unset *and* Spark runs in local mode (tests, the bench) do we create a
private folder under the system temp dir.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "examlytics") -> SparkSession:
    """A session with this package's settings.

    Without ``master`` (the jobs) the master, memory and shuffle partitions are
    those of the submission: settings made in code would override them.  Tests
    and the bench pass ``master`` and get a local session.  On a cluster set
    ``spark.sql.shuffle.partitions`` to about input bytes / 128 MB for the
    largest shuffle; AQE coalesces the small ones.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = (builder.master(master).config("spark.ui.enabled", "false")
                   .config("spark.ui.showConsoleProgress", "false")
                   .config("spark.driver.memory", os.environ.get("EXAMLYTICS_DRIVER_MEMORY", "16g")))
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # ~128 MB per input split and per post-shuffle partition: fits executor
        # memory with room for sort/aggregate buffers; AQE merges small ones.
        .config("spark.sql.files.maxPartitionBytes", "128m")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Return the shared folder for scratch tables and checkpoints.

    Reads ``spark.checkpoint.dir`` (or the SparkContext checkpoint dir).  If
    neither is set and the master is local, a private temp folder is created
    and registered; on a cluster an unset value is an error, because a
    machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...)")
        root = tempfile.mkdtemp(prefix="examlytics-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location under the shared root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
