"""Session helpers: building a local session, durable cuts, shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: str | int = "*", app: str = "evalspark") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    partitions = 8 if cpus == "*" else max(int(cpus), 1)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only where neither that
    setting nor a checkpoint directory exists (a local test session) is a
    temporary folder chosen.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="evalspark-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a written intermediate table."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def durable(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the shared folder and go on from the written table.

    A lost executor re-reads the same rows, whatever a re-evaluation would give.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, "cut")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
