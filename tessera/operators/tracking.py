"""Fields followed over heading angles: peaks per angle, closed chains, paths by region, matches with sampled fields."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.safe import heading_weight
from tessera.operators import binning, fits, grids, neighbors
from tessera.runtime import ship

BY = ["cell_id"]


def heading_maps(points: DataFrame, angle: str, layers: int, size: int, power: int = 1, by: list[str] = BY) -> DataFrame:
    """n and k per key, layer and bin, weighted by max(0, cos(angle - phi))^power for layers evenly spaced angles phi.

    Points meet the angles by an explode (layers rows a point, before partial aggregation)."""
    spread = points.withColumn("layer", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(layers - 1).cast("long"))))
    w = heading_weight(F.col(angle), F.col("layer") * (2 * math.pi / layers), power)
    return binning.visits_and_counts(spread.withColumn("_w", w).where("_w > 0"), size, F.col("_w"), [*by, "layer"])


def heading_peaks(points: DataFrame, angle: str, layers: int, size: int, power: int = 1, radius: float = 1.0, by: list[str] = BY) -> DataFrame:
    """Interpolated peaks (key, layer, id, x, y, height) of one variational fit per key and angle."""
    keys = [*by, "layer"]
    packed = grids.pack(heading_maps(points, angle, layers, size, power, by), size, size, ["n", "k"], keys)
    fitted = fits.fit_maps(packed, by=keys)
    field = grids.unpack(fitted.select(*keys, "h", "w", "log_rate"), ["log_rate"], keys)
    peaks = grids.interpolate_peaks(field, "log_rate", size, size, radius, by=keys)
    return peaks.select(*keys, F.col("rank").alias("id"), "x", "y", "height")


def link_peaks(chains: DataFrame, peaks: DataFrame, layers: int, radius: float, reach: float | None = None) -> DataFrame:
    """Chains (chain_id, layer, id, pos along the path) trimmed to loops: while a chain is longer than layers + 1 or its ends
    are further apart than `reach` (twice the radius), the end further from the middle of what is left goes (the last of
    two equal ones); chains shorter than half the layers are dropped.  Without pos the order is by layer.  A chain is one
    task's group: it has a few nodes a layer."""
    ship(chains.sparkSession)
    reach = 2 * radius if reach is None else reach

    def trim(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["at", "layer", "id"]).reset_index(drop=True)
        xy, a, b = g[["x", "y"]].to_numpy(), 0, len(g)
        sums = np.concatenate([np.zeros((1, 2)), np.cumsum(xy, axis=0)])
        while b - a > 1 and (b - a > layers + 1 or np.hypot(*(xy[a] - xy[b - 1])) > reach):
            middle = (sums[b] - sums[a]) / (b - a)
            if np.hypot(*(xy[a] - middle)) > np.hypot(*(xy[b - 1] - middle)):
                a += 1
            else:
                b -= 1
        kept = g.iloc[a:b] if b - a >= layers // 2 else g.iloc[:0]
        return kept.assign(pos=np.arange(len(kept)))[["chain_id", "pos", "layer", "id", "x", "y"]]

    at = F.col("pos") if "pos" in chains.columns else F.col("layer")
    joined = chains.select("chain_id", "layer", "id", at.cast("long").alias("at")).join(peaks.select("layer", "id", "x", "y"), ["layer", "id"])
    return joined.groupBy("chain_id").applyInPandas(trim, "chain_id long, pos long, layer long, id long, x double, y double")


def linked_edges(paths: DataFrame) -> DataFrame:
    """Edges (layer, src, dst) between neighbours of trimmed paths(chain_id, pos, layer, id)."""
    order = Window.partitionBy("chain_id").orderBy("pos")
    return paths.select("layer", F.col("id").alias("src"), F.lead("id").over(order).alias("dst")).where("dst is not null")


def path_regions(paths: DataFrame, centroids: DataFrame, radius: float | None = None) -> DataFrame:
    """Middle of every path (chain_id, x, y) with the closest centroid's id, or -1; `shared`: another path has it too."""
    middle = paths.groupBy("chain_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("nodes"))
    dealt = neighbors.voronoi(middle, centroids, "id", radius=radius)
    count = F.count(F.lit(1)).over(Window.partitionBy("region"))
    return dealt.withColumn("shared", (F.col("region") >= 0) & (count > 1))


def tracked_matches(tracked: DataFrame, sampled: DataFrame, radius: float) -> DataFrame:
    """Pairs (tracked, sampled, distance) that are closest to each other within the radius; every id counts, 0 too."""
    a = neighbors.nearest(tracked.select("id", "x", "y"), sampled.select("id", "x", "y"), "id", radius=radius).select(F.col("id").alias("tracked"), F.col("near_id").alias("sampled"), F.col("near_distance").alias("distance"))
    b = neighbors.nearest(sampled.select("id", "x", "y"), tracked.select("id", "x", "y"), "id", radius=radius).select(F.col("id").alias("sampled"), F.col("near_id").alias("tracked"))
    return a.where("sampled is not null").join(b.where("tracked is not null"), ["tracked", "sampled"]).select("tracked", "sampled", "distance")


def displacement(tracked: DataFrame) -> DataFrame:
    """Mahalanobis displacement of tracked(dx, dy, xx, xy, yy): sqrt(d' S^-1 d), null for a singular covariance."""
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    q = (F.col("yy") * F.col("dx") * F.col("dx") - F.col("xy") * F.col("dx") * F.col("dy") * 2 + F.col("xx") * F.col("dy") * F.col("dy")) / F.when(det > 1e-300, det)
    return tracked.withColumn("displacement", F.sqrt(q))
