"""Session construction and the shared scratch folder."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Splitting a skewed join may cost one more exchange; a straggler costs more.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
#: What one task takes from a shuffle or a file does not grow with the tables: many partitions, joined again up to a fixed size.
PARTITIONS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "16m",
}
#: Shuffle files go with the job that wrote them: jobs hand on written tables. Else they stay until the driver collects its garbage.
CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def build(app: str = "riskspark", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the plans in this package count on."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        **ADAPTIVE,
        **PARTITIONS,
        **CLEANUP,
        # Call sites are looked up per column expression: a cost when plans are built in code.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> None:
    """Turn adaptive skew handling on in a session that was built elsewhere."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)


def bound_tasks(spark: SparkSession) -> None:
    """Bound what a task takes from a shuffle or a file in a session that was built elsewhere."""
    for key, value in PARTITIONS.items():
        spark.conf.set(key, value)


def clean_up(spark: SparkSession) -> None:
    """Keep shuffle files only while their job runs in a session that was built elsewhere."""
    for key, value in CLEANUP.items():
        spark.conf.set(key, value)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: on a cluster a
    machine-local folder would be lost with the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path for one written intermediate table."""
    return os.path.join(checkpoint_root(spark), f"riskspark-{purpose}-{uuid.uuid4().hex}")


def materialise(df, purpose: str):
    """Write ``df`` to the scratch folder and read it back.

    This cuts lineage, survives lost executors, and gives later plans real size statistics.
    """
    path = scratch_path(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
