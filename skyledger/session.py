"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on; everything else is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The JVM never compiles methods above 8000 bytes of bytecode; a fused stage of
    # trigonometry beyond that would run interpreted (8x slower on the candidate join),
    # so Spark is told to split such stages into smaller methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(app: str = "skyledger", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("SKYLEDGER_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the runtime options the results depend on (time zone) or the plans rely on (AQE)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to all cores, before work that is heavy per row: a small file is read by one task."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a session that is one process may go without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from the files.

    Unlike cached blocks the files outlive lost executors, and unlike a plain
    checkpoint they bring sizes and column pruning to the queries reading them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
