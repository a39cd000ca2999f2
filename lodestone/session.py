"""Session defaults, checkpoint folder and size-checked broadcasting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows allowed in a broadcast build side. Callers keep rows under ~200 bytes, so
# this bounds one broadcast to roughly 100 MB whatever the corpus size.
BROADCAST_ROW_LIMIT = 500_000


def build_session(app: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only where all work runs on this machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="lodestone-checkpoint-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: later readers see one fixed result and survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back: as fixed as a checkpoint, but compressed by column."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/lodestone-{uuid.uuid4().hex}/{label}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows; counted per task, so no rows meet in one."""
    return df.count() <= limit


def small_side(df: DataFrame, fits_limit: bool) -> DataFrame:
    """Broadcast hint for a side whose size was checked; otherwise a plain shuffle join."""
    return F.broadcast(df) if fits_limit else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition an input that arrives in fewer partitions than there are cores.

    A small file read as one partition would run expensive per-row work on one core. Inputs
    of many splits are left alone, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores, *keys)
