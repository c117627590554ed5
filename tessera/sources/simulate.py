"""Generators: hexagonal rate maps, simulated recordings and random draws, seeded per key."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import ship


def hex_grid(spark: SparkSession, size: int, period: float) -> DataFrame:
    """iy, ix, value: three cosines 60 degrees apart on a grid centred on bin size div 2."""
    x, y = F.col("ix") - size // 2, F.col("iy") - size // 2
    value = sum((F.cos((x * math.cos(a) + y * math.sin(a)) * (2 * math.pi / period)) for a in (0.0, math.pi / 3, 2 * math.pi / 3)), F.lit(0.0))
    cells = spark.range(size * size).select(F.floor(F.col("id") / size).cast("int").alias("iy"), (F.col("id") % size).cast("int").alias("ix"))
    return cells.withColumn("value", value)


def rate_map(spark: SparkSession, size: int, period: float, contrast: float = 0.8, mean: float = 0.02, pad: float = 0.1) -> DataFrame:
    """iy, ix, rate: exp(contrast * hex) scaled to the mean on the inner square, 0 on the padding."""
    edge = int(round(size * pad))
    inside = F.col("iy").between(edge, size - 1 - edge) & F.col("ix").between(edge, size - 1 - edge)
    raw = hex_grid(spark, size, period).withColumn("_r", F.when(inside, F.exp(F.col("value") * contrast)))
    average = raw.agg(F.avg("_r").alias("_m"))
    return raw.crossJoin(F.broadcast(average)).select("iy", "ix", F.coalesce(F.col("_r") / F.col("_m") * mean, F.lit(0.0)).alias("rate"))


def expected_maps(spark: SparkSession, size: int = 128, period: float = 13.0, contrast: float = 0.5, mean: float = 0.09, pad: float = 0.1) -> DataFrame:
    """iy, ix, rate, background and visits: exp(contrast * hex) scaled to the mean over the whole grid and 0 on the padding;
    the rate less a part that grows with the distance from the middle (all of it at one inner side); and expected visits,
    which fall off from a point a fifth of the side above the middle."""
    edge = int(size * pad)
    inside = F.col("iy").between(edge, size - 1 - edge) & F.col("ix").between(edge, size - 1 - edge)
    raw = hex_grid(spark, size, period).withColumn("_r", F.exp(F.col("value") * contrast))
    average = raw.agg(F.avg("_r").alias("_m"))
    y, x = F.col("iy") - size // 2, F.col("ix") - size // 2
    far, off = F.hypot(x, y) / float(size - 2 * edge), F.hypot(x / float(size), y / float(size) - 0.2)
    out = raw.crossJoin(F.broadcast(average)).withColumn("rate", F.when(inside, F.col("_r") / F.col("_m") * mean).otherwise(0.0))
    return out.select("iy", "ix", "rate", (F.col("rate") * (1 - far)).alias("background"), F.when(inside, (1 - off) * 2).otherwise(0.0).alias("visits"))


def counts(rates: DataFrame, visits: float | None, seed: int = 0) -> DataFrame:
    """Adds n (Poisson visits, 0 where the rate is 0) and k (Poisson counts), seeded by bin; visits None: the expected visits
    of each bin are in a column of that name."""
    ship(rates.sparkSession)

    def draw(batches):
        for b in batches:
            n, k = [], []
            for iy, ix, r, v in zip(b["iy"], b["ix"], b["rate"], b["visits"] if visits is None else [visits] * len(b)):
                g = np.random.default_rng((seed, int(iy), int(ix)))
                n.append(float(g.poisson(v)) if r > 0 else 0.0)
                k.append(float(g.poisson(n[-1] * r)))
            yield b[["iy", "ix", "rate"]].assign(n=n, k=k)

    return rates.mapInPandas(draw, "iy int, ix int, rate double, n double, k double")


def background_map(size: int, period: float, contrast: float = 0.5, mean: float = 1.2, pad: float = 0.15, background: bool = True) -> np.ndarray:
    """exp(contrast * hex) on the inner square, 0 on the padding; with a background that falls off from the middle in
    proportion to the distance (0 at one inner side); scaled so that the mean inside is `mean`."""
    edge = int(size * pad)
    z = np.arange(size) - size // 2
    x, y = z[None, :], z[:, None]
    wave = sum(np.cos((x * np.cos(a) + y * np.sin(a)) * (2 * np.pi / period)) for a in (0, np.pi / 3, 2 * np.pi / 3))
    inside = np.zeros((size, size), dtype=bool)
    inside[edge : size - edge, edge : size - edge] = True
    rate = np.exp(contrast * wave) * inside
    if background:
        rate = rate * np.maximum(1 - np.hypot(x, y) / (size - 2 * edge), 0)
    return rate * (mean / rate[inside].mean())


def explorations(spark: SparkSession, cells: int, seconds: float, fs: float, period: float, mean_hz: float = 1.2, seed: int = 0, size: int = 128, step: float = 0.02, contrast: float = 0.5, pad: float = 0.15) -> DataFrame:
    """cell_id, t, x, y, s: noise-driven targets clipped to the unit square, followed through two 0.9 / 0.1 low-pass
    filters and laid on the inner square of a `size` grid, with Poisson events of `background_map` there; `period` is a
    share of the grid's side, x and y lie in the unit square on bins; one recording a key."""
    ship(spark)

    def record(g: pd.DataFrame) -> pd.DataFrame:
        cell = int(g["cell_id"].iloc[0])
        r = np.random.default_rng((seed, cell))
        t = int(seconds * fs)
        edge = int(size * pad)
        rates = background_map(size, period * size, contrast, mean_hz, pad)
        target, fast, slow = np.array([0.5, 0.5]), np.array([0.5, 0.5]), np.array([0.5, 0.5])
        path = np.empty((t, 2))
        noise = r.standard_normal((t, 2)) * step
        for k in range(t):
            target = np.clip(target + noise[k], 0, 1)
            fast = 0.9 * fast + 0.1 * target
            slow = 0.9 * slow + 0.1 * fast
            path[k] = slow
        at = (path * (size - 2 * edge) + edge).astype(np.int64)
        s = r.poisson(rates[at[:, 1], at[:, 0]] / fs).astype(float)
        return pd.DataFrame({"cell_id": cell, "t": np.arange(t), "x": at[:, 0] / size, "y": at[:, 1] / size, "s": s})

    keys = spark.range(cells).withColumnRenamed("id", "cell_id")
    return keys.groupBy("cell_id").applyInPandas(record, "cell_id long, t long, x double, y double, s double")
