"""Session helpers shared by tests, the benchmark and the streaming jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(app: str = "sitescope", cores: str = "*", **conf: str) -> SparkSession:
    """A session for one machine; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Read from ``spark.checkpoint.dir``. Only a local session without that setting
    falls back to a temporary folder; a cluster without it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sitescope-"))
    return context.getCheckpointDir().rstrip("/").removeprefix("file:")


def checkpointed(frame):
    """Reliable checkpoint of a frame in the shared folder."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint()
