"""Arenas, unit conversions, hulls, masks, distances and ellipses."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numerics import convex_hull
from tessera.operators import neighbors
from tessera.runtime import ship

BY = ["cell_id"]


def arena(points: DataFrame, bins: int = 128, margin: float = 0.15, by: list[str] = BY) -> DataFrame:
    """Per key: x0, x1, y0, y1 (padded box with square bins), h, w (bins) and res (bins a unit of length).

    The box is padded by max(width, height) * 2 * margin in all, the long side gets `bins` bins and the short one its
    rounded share, and the side that would make bins oblong grows about its middle.
    """
    box = points.groupBy(*by).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    pad = F.greatest(F.col("b") - F.col("a"), F.col("d") - F.col("c")) * (2 * margin)
    box = box.withColumn("pad", pad).withColumn("sx", F.col("b") - F.col("a") + F.col("pad")).withColumn("sy", F.col("d") - F.col("c") + F.col("pad"))
    long_x = F.col("sx") >= F.col("sy")
    w = F.when(long_x, F.lit(bins)).otherwise(F.round(F.col("sx") / F.col("sy") * bins)).cast("int")
    h = F.when(long_x, F.round(F.col("sy") / F.col("sx") * bins)).otherwise(F.lit(bins)).cast("int")
    box = box.withColumn("w", w).withColumn("h", h)
    edge = F.greatest(F.col("sx") / F.col("w"), F.col("sy") / F.col("h"))
    mx, my = (F.col("a") + F.col("b")) / 2, (F.col("c") + F.col("d")) / 2
    return box.withColumn("edge", edge).select(
        *by,
        (mx - F.col("edge") * F.col("w") / 2).alias("x0"),
        (mx + F.col("edge") * F.col("w") / 2).alias("x1"),
        (my - F.col("edge") * F.col("h") / 2).alias("y0"),
        (my + F.col("edge") * F.col("h") / 2).alias("y1"),
        "h",
        "w",
        (1 / F.col("edge")).alias("res"),
    )


def square_bins(arenas: DataFrame) -> DataFrame:
    """arenas (x0, x1, y0, y1, h, w) whose bins are square to within one bin of a side; others raise."""
    aspect = (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    fine = (aspect * F.col("h") >= F.col("w") - 1) & (aspect * F.col("h") <= F.col("w") + 1)
    told = F.concat(F.lit("an arena of aspect "), aspect.cast("string"), F.lit(" on "), F.col("w").cast("string"), F.lit(" x "), F.col("h").cast("string"), F.lit(" bins"))
    # inside the column that all later steps read, so that no optimiser can leave it out
    return arenas.withColumn("w", F.when(fine, F.col("w")).otherwise(F.raise_error(told).cast("int")))


def meters_to_unit(x: Column, low: Column, high: Column) -> Column:
    return (x - low) / (high - low)


def unit_to_meters(u: Column, low: Column, high: Column) -> Column:
    return u * (high - low) + low


def unit_to_bins(u: Column, size: Column) -> Column:
    return u * size


def bins_to_unit(b: Column, size: Column) -> Column:
    return b / size


def normalised(points: DataFrame, margin: float = 0.1, by: list[str] = BY) -> DataFrame:
    """x and y scaled into a square around the middle of the box, strictly inside the unit square."""
    box = points.groupBy(*by).agg(F.min("x").alias("_a"), F.max("x").alias("_b"), F.min("y").alias("_c"), F.max("y").alias("_d"))
    edge = F.greatest(F.col("_b") - F.col("_a"), F.col("_d") - F.col("_c")) * (0.5 + margin)
    scale = (1 - 1e-6) / (edge * 2)
    joined = points.join(box, by)
    out = joined.withColumn("_s", scale).withColumn("x", (F.col("x") - (F.col("_a") + F.col("_b")) / 2) * F.col("_s") + 0.5)
    return out.withColumn("y", (F.col("y") - (F.col("_c") + F.col("_d")) / 2) * F.col("_s") + 0.5).select(*points.columns)


def bin_centres(height: int, width: int) -> Column:
    """Array of (iy, ix, y, x) of a grid's bin centres in the unit square."""
    cells = [F.struct(F.lit(i).alias("iy"), F.lit(j).alias("ix"), F.lit((i + 0.5) / height).alias("y"), F.lit((j + 0.5) / width).alias("x")) for i in range(height) for j in range(width)]
    return F.array(*cells)


def grid(spark, height: int, width: int, ends: bool = False) -> DataFrame:
    """iy, ix, y, x of all bins; `ends`: positions include 0 and 1."""
    n = spark.range(height * width)
    iy, ix = F.floor(F.col("id") / width).cast("int"), (F.col("id") % width).cast("int")
    if ends:
        return n.select(iy.alias("iy"), ix.alias("ix"), (iy / float(max(height - 1, 1))).alias("y"), (ix / float(max(width - 1, 1))).alias("x"))
    return n.select(iy.alias("iy"), ix.alias("ix"), ((iy + 0.5) / height).alias("y"), ((ix + 0.5) / width).alias("x"))


def hull(points: DataFrame, by: list[str] = BY) -> DataFrame:
    """Edges of the convex hull per key: edge_id, ax, ay, bx, by_ (counter-clockwise) and the half-plane
    a * x + b * y + c <= 0.  Partial hulls per partition and key, then one hull per key over those."""
    ship(points.sparkSession)
    schema = ", ".join(f"{points.select(k).schema[0].name} {points.select(k).schema[0].dataType.simpleString()}" for k in by)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, g in batch.groupby(by, dropna=False):
                xy = g[["x", "y"]].dropna().to_numpy()
                if key in held:
                    xy = np.concatenate([held[key], xy])
                held[key] = convex_hull(xy)
        for key, xy in held.items():
            yield pd.DataFrame({**{k: [v] * len(xy) for k, v in zip(by, key)}, "x": xy[:, 0], "y": xy[:, 1]})

    def final(g: pd.DataFrame) -> pd.DataFrame:
        p = convex_hull(g[["x", "y"]].to_numpy())
        q = np.roll(p, -1, axis=0)
        a, b = q[:, 1] - p[:, 1], p[:, 0] - q[:, 0]
        size = np.maximum(np.hypot(a, b), 1e-300)
        out = pd.DataFrame({"edge_id": np.arange(len(p)), "ax": p[:, 0], "ay": p[:, 1], "bx": q[:, 0], "by_": q[:, 1], "a": a / size, "b": b / size, "c": -(a * p[:, 0] + b * p[:, 1]) / size})
        for k in by[::-1]:
            out.insert(0, k, g[k].iloc[0])
        return out

    parts = points.select(*by, "x", "y").mapInPandas(partial, f"{schema}, x double, y double")
    return parts.groupBy(*by).applyInPandas(final, f"{schema}, edge_id long, ax double, ay double, bx double, by_ double, a double, b double, c double")


def half_planes(edges: DataFrame, by: list[str] = BY) -> DataFrame:
    """One row per key with `planes`, the array of its half-planes (as many as the hull has corners)."""
    return edges.groupBy(*by).agg(F.collect_list(F.struct("a", "b", "c")).alias("planes"))


def in_hull(x: Column, y: Column, planes: Column, slack: float = 1e-12) -> Column:
    return F.forall(planes, lambda p: p["a"] * x + p["b"] * y + p["c"] <= slack)


def hull_mask(edges: DataFrame, height: int, width: int, by: list[str] = BY, ends: bool = False) -> DataFrame:
    """(key, iy, ix) of bins whose position lies in the hull."""
    planes = half_planes(edges, by)
    cells = grid(edges.sparkSession, height, width, ends)  # height * width rows
    return planes.crossJoin(F.broadcast(cells)).where(in_hull(F.col("x"), F.col("y"), F.col("planes"))).select(*by, "iy", "ix")


def dilate(mask: DataFrame, radius: float, height: int, width: int, by: list[str] = BY) -> DataFrame:
    """Bins within `radius` bins of a mask bin: each bin explodes to its disk, then distinct."""
    m = math.floor(radius)
    disk = [(i, j) for i in range(-m, m + 1) for j in range(-m, m + 1) if i * i + j * j <= radius * radius]
    near = F.array(*[F.struct((F.col("iy") + i).alias("iy"), (F.col("ix") + j).alias("ix")) for i, j in disk])
    return mask.select(*by, F.inline(near)).where(f"iy between 0 and {height - 1} and ix between 0 and {width - 1}").distinct()


def mask_hull(mask: DataFrame, height: int, width: int, by: list[str] = BY, shift: float = 0.5) -> DataFrame:
    """Hull edges per key of the mask's bins (bin centres in the unit square; shift 0: lower corners)."""
    return hull(mask.select(*by, ((F.col("ix") + shift) / width).alias("x"), ((F.col("iy") + shift) / height).alias("y")), by)


def arena_of_mask(mask: DataFrame, height: int, width: int, resolution: int = 1, by: list[str] = BY) -> DataFrame:
    """(key, iy, ix) of an arena given as a mask, on a grid `resolution` times as fine: bins whose centre lies in the hull of
    the mask's lower bin corners; at resolution 1 the mask itself."""
    if resolution == 1:
        return mask.select(*by, "iy", "ix").distinct()
    return hull_mask(mask_hull(mask, height, width, by, 0.0), height * resolution, width * resolution, by)


def contains(x: Column, y: Column, planes: Column, unit: str, height: int, width: int, box: list[Column]) -> Column:
    """Whether a point told in "unit", "bin" or "meter" coordinates lies in a hull of the unit square; box: x0, x1, y0, y1."""
    if unit == "bin":
        x, y = bins_to_unit(x, F.lit(width)), bins_to_unit(y, F.lit(height))
    elif unit == "meter":
        x, y = meters_to_unit(x, box[0], box[1]), meters_to_unit(y, box[2], box[3])
    elif unit != "unit":
        raise ValueError(f"unknown unit {unit}")
    return in_hull(x, y, planes)


def physical(x: Column, y: Column, scale: float, x0: float, y0: float) -> list[Column]:
    """x and y of the unit square in physical units, p / scale + corner; points outside the square raise."""
    inside = x.between(0, 1) & y.between(0, 1)
    fail = F.raise_error(F.lit("points outside the unit square")).cast("double")
    return [F.when(inside | x.isNull() | y.isNull(), v / scale + low).otherwise(fail).alias(n) for v, low, n in ((x, x0, "x"), (y, y0, "y"))]


def centred(spark, height: int, width: int) -> DataFrame:
    """iy, ix with the offset (y, x) from the middle bin, its length r, and the integer frequencies (fy, fx) of the bin."""
    cells = grid(spark, height, width).select("iy", "ix")
    y, x = F.col("iy") - height // 2, F.col("ix") - width // 2
    turn = lambda i, n: F.when(F.col(i) < (n + 1) // 2, F.col(i)).otherwise(F.col(i) - n)
    return cells.select("iy", "ix", y.alias("y"), x.alias("x"), F.hypot(y.cast("double"), x.cast("double")).alias("r"), turn("iy", height).alias("fy"), turn("ix", width).alias("fx"))


def boundary_distance(points: DataFrame, mask: DataFrame, height: int, width: int, by: list[str] = BY, key: str = "point_id") -> DataFrame:
    """Signed distance in bins from points (key, bx, by_ in bin units, of a bin with iy, ix) to the mask's edge:
    to the nearest outside bin for points inside, minus that to the nearest inside bin for points outside; null where a
    mask leaves no bin outside.  Points of keys without a mask are dropped.

    The nearest bin of the other kind always touches a bin of the point's own kind, so only the bins on either side of the
    edge are searched (`neighbors.nearest`); whether a point is inside comes from an equi-join on its bin.
    """
    inner = mask.select(*by, "iy", "ix").distinct()
    step = F.array(*[F.struct((F.col("iy") + i).alias("iy"), (F.col("ix") + j).alias("ix")) for i, j in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    around = lambda df: df.select(*by, F.inline(step)).where(f"iy between 0 and {height - 1} and ix between 0 and {width - 1}").distinct()
    out = around(inner).join(inner, [*by, "iy", "ix"], "left_anti")
    rim = around(out).join(inner, [*by, "iy", "ix"], "left_semi")
    spot = lambda df, own: df.select(*by, F.lit(own).alias("own"), (F.col("iy") * width + F.col("ix")).alias("bin"), F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"))
    owned = points.join(inner.withColumn("own", F.lit(True)), [*by, "iy", "ix"], "left").join(inner.select(*by).distinct(), by, "left_semi")
    asked = owned.select(*by, F.coalesce("own", F.lit(False)).alias("own"), key, F.col("bx").cast("double").alias("x"), F.col("by_").cast("double").alias("y"))
    near = neighbors.nearest(asked, spot(out, True).unionByName(spot(rim, False)), "bin", [*by, "own"])
    return near.select(*by, key, F.when(F.col("own"), F.col("near_distance")).otherwise(-F.col("near_distance")).alias("distance"))


def ellipse_radius(p: float, mode: str = "2D") -> float:
    """Standard deviations of the contour with mass p: of the plane (2D) or of each axis (1D)."""
    return math.sqrt(-2 * math.log(1 - p)) if mode == "2D" else NormalDist().inv_cdf(0.5 + p / 2)


def ellipse_axes(xx: Column, xy: Column, yy: Column) -> dict[str, Column]:
    """Eigenvalues (major, minor) and the major axis' angle of a 2 x 2 covariance."""
    half, diff = (xx + yy) / 2, (xx - yy) / 2
    root = F.sqrt(diff * diff + xy * xy)
    return {"major": half + root, "minor": F.greatest(half - root, F.lit(0.0)), "angle": F.atan2(xy * 2, xx - yy) / 2}


def ellipse(gaussians: DataFrame, p: float = 0.95, steps: int = 36, mode: str = "2D") -> DataFrame:
    """Vertices (pos, x, y) of the contour of gaussians(..., mx, my, xx, xy, yy)."""
    r = ellipse_radius(p, mode)
    out = gaussians
    for n, c in ellipse_axes(F.col("xx"), F.col("xy"), F.col("yy")).items():
        out = out.withColumn(n, c)
    out = out.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    turn = F.col("pos") * (2 * math.pi / steps)
    u, v = F.sqrt("major") * F.cos(turn) * r, F.sqrt("minor") * F.sin(turn) * r
    x = F.col("mx") + u * F.cos("angle") - v * F.sin("angle")
    y = F.col("my") + u * F.sin("angle") + v * F.cos("angle")
    keys = [c for c in gaussians.columns if c not in ("mx", "my", "xx", "xy", "yy")]
    return out.select(*keys, "pos", x.alias("x"), y.alias("y"))
