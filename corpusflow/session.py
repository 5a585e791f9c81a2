"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of tables that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def scale_conf(input_bytes: int, cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Partition sizing for an input of ``input_bytes`` on ``cores`` cores.

    Scan splits and post-shuffle partitions aim at ``target_partition_bytes``
    (so a task's working set fits executor memory and spills stay rare); the
    shuffle starts with at least two partitions per core and one per target
    size, and AQE coalesces the small ones and splits skewed ones.
    """
    n = max(2 * cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "corpusflow", extra: dict | None = None,
              input_bytes: int | None = None, cores: int | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    With ``input_bytes`` (and ``cores``) the partition settings come from
    ``scale_conf``; otherwise ``shuffle_partitions`` is used as given.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if input_bytes is not None:
        conf.update(scale_conf(input_bytes, cores or shuffle_partitions))
    conf.setdefault("spark.driver.memory", os.environ.get("CORPUSFLOW_DRIVER_MEMORY", "8g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a shared filesystem).
    Only a local-mode session without the setting gets a private scratch
    folder, which is what tests use.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return d
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    d = tempfile.mkdtemp(prefix="corpusflow-ckpt-")
    sc.setCheckpointDir(d)
    return d


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    import uuid
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"
