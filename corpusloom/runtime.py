"""Session-level helpers: durable cut points, size checks, input spreading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
MIN_SPREAD_BYTES = 256 * 1024


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point the context at the shared checkpoint folder the cluster names.

    Only a local master, which has no cluster storage, falls back to a temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get(CHECKPOINT_CONF, None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="corpusloom-checkpoint-")
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and cut its lineage; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder.

    Unlike a checkpoint it leaves behind what the optimizer has inferred so far, which grows with every join of a long
    sequence of rounds.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer's size estimate of ``df``; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes below which Spark itself would broadcast a join side (-1 when disabled)."""
    raw = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(raw)


def fits_broadcast(df: DataFrame) -> bool:
    return estimated_bytes(df) <= broadcast_limit(df.sparkSession)


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a plain scan that has fewer splits than the cluster has cores.

    Per-row text work is CPU-bound, so a handful of input splits would leave most cores idle. A scan
    that already has enough splits (any large input) is returned untouched: no shuffle is added.
    Use on scans only; counting the splits plans ``df`` but runs nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(df) < MIN_SPREAD_BYTES or df._jdf.rdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
