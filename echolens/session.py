"""Session factory and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

# Settings the jobs rely on; all can be set on a running session.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where the next step then needs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
SETTINGS = {**RUNTIME, "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}


def session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """Build (or reuse) a session. On a cluster leave ``master`` and the shuffle width to spark-submit."""
    builder = SparkSession.builder.appName("echolens")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def tuned(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or a scratch folder in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    scratch = tempfile.mkdtemp(prefix="echolens-")
    spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch


def run_dir(spark: SparkSession, label: str) -> str:
    """A new sub-folder name for one run; never reused, so nothing is overwritten."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{os.urandom(8).hex()}"


def settled(df: DataFrame) -> DataFrame:
    """Write the rows out once and read them back.

    Later branches then see the same layout and repeat no work. A per-key aggregate that a larger table
    joins to is settled too: AQE splits a hot key only where both join inputs are plain shuffles.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Broadcast a per-group table once it is known to be short; else leave the join to Catalyst and AQE.

    Keeps a hot group of the other side from being shuffled to one place when the groups are few.
    """
    held = settled(df)
    return F.broadcast(held) if held.limit(rows + 1).count() <= rows else held
