"""Session defaults and the shared folder used by jobs that write."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a cluster deployment may override with its own spark-defaults.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a JSON reply that repeats a field counts with its last value
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app: str = "answergauge", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the cluster's shared folder.

    The folder comes from ``spark.checkpoint.dir``. A local-mode session without
    that setting (tests, laptops) uses its warehouse folder; on a cluster a
    machine-local folder would be invisible to other executors, so the call
    fails instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith(("local[", "local*")):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For a narrow result of an expensive scan that a job reads several times. It
    outlives a lost executor, which a cached or locally checkpointed one does not.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    It cuts lineage so that it survives lost executors. The shuffle files behind
    the table are of no use any more; collecting the driver's garbage lets Spark
    remove them before the next job fills the disks.
    """
    out = written(df, purpose)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out
