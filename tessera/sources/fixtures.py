"""Views of the test tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPOCH_MICROS = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, x, y, s, w, h of the line items: weighted points in the unit square, without order."""
    items = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("double")
    bounds = items.agg(F.min(price).alias("mn"), F.max(price).alias("mx"))  # one row
    return items.crossJoin(F.broadcast(bounds)).select(
        (F.col("l_suppkey") % 4).cast("long").alias("cell_id"),
        ((F.col("l_quantity").cast("double") - 1) / 49.0).alias("x"),
        ((price - F.col("mn")) / (F.col("mx") - F.col("mn"))).alias("y"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("s"),
        (1.0 - F.col("l_discount").cast("double")).alias("w"),
        ((F.col("l_linenumber").cast("double") - 1) / 7.0).alias("h"),
    )


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, t, x (null: missing), y, s of the events: one ordered series a user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("cell_id"),
        (F.row_number().over(order) - 1).cast("long").alias("t"),
        F.when(F.col("event_type") != "error", F.col("value") / 100).alias("x"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("y"),
        F.when(F.col("event_type") == "click", 1.0).otherwise(0.0).alias("s"),
    )


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, t_sec of click events."""
    return table(spark, sf_dir, "events").where("event_type = 'click'").select(
        F.col("user_id").alias("cell_id"), ((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_MICROS) / 1e6).alias("t_sec")
    )


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, x, y of the embeddings' first two components."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"),
    )
