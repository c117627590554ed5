"""Tables, and lineage cut in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.runtime import cut

__all__ = ["cut", "shuffle_partitions", "sweep", "table"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sweep(spark: SparkSession) -> None:
    """Let the driver's JVM collect now: Spark removes the files of shuffles and checkpoints only when the plans that made
    them are collected, which may otherwise be after the disk is full."""
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
