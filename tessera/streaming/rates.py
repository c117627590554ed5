"""Streaming rate maps: n and k are plain sums of corner shares, so windows of a stream add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.binning import corners, square


def windowed_counts(points: DataFrame, size: int, time: str = "ts", late: str = "10 minutes", window: str = "1 hour", by: list[str] = ["cell_id"]) -> DataFrame:  # noqa: B006
    """(window, key, iy, ix, n, k) of a stream (or table) of points with x, y in [0, 1] and event count s."""
    ay, ax = square(size)
    spread = points.withWatermark(time, late).withColumn("_y", F.explode(F.array(*corners(ay)))).withColumn("_x", F.explode(F.array(*corners(ax))))
    share = F.col("_y.p") * F.col("_x.p")
    cells = spread.select(time, *by, F.col("_y.i").alias("iy"), F.col("_x.i").alias("ix"), share.alias("share"), "s").where("share > 0")
    sums = cells.groupBy(F.window(time, window), *by, "iy", "ix").agg(F.sum("share").alias("n"), F.sum(F.col("share") * F.col("s")).alias("k"))
    return sums.select(F.col("window.start").alias("start"), *by, "iy", "ix", "n", "k")
