"""Weighted histograms of points: multilinear and nearest, with periodic axes.

One explode of at most 2**D corners and one aggregation with map-side partial
sums; the shuffle carries one row for each key and bin a task.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.safe import sdiv


@dataclass(frozen=True)
class Axis:
    """A column in [0, 1] dealt to `size` bins; `wrap`: periodic; `open_`: bins at p * size, for p < 1."""

    column: str
    size: int
    out: str
    wrap: bool = False
    open_: bool = False


def _checked(p: Column, axis: Axis) -> Column:
    top = (p >= 1) if axis.open_ else (p > 1)
    return F.when((p < 0) | top, F.raise_error(F.concat(F.lit(f"{axis.column} outside the unit interval: "), p.cast("string"))).cast("double")).otherwise(p)


def corners(axis: Axis) -> list[Column]:
    """Two structs (index, share) of one axis."""
    u = _checked(F.col(axis.column), axis) * float(axis.size if axis.wrap or axis.open_ else axis.size - 1)
    low = F.floor(u).cast("int")
    part = u - low
    high = low + 1
    if axis.wrap or axis.open_:
        low, high = low % axis.size, high % axis.size
    return [F.struct(low.alias("i"), (1 - part).alias("p")), F.struct(high.alias("i"), part.alias("p"))]


def bin_linear(points: DataFrame, axes: list[Axis], sums: dict[str, Column], by: list[str] = ["cell_id"]) -> DataFrame:  # noqa: B006
    """`by`, one index column per axis and the sums, each point's mass shared among its corners by distance.

    A point at 1 lies wholly in the last bin of a closed axis.  Bins without mass are absent.
    """
    split = points.select(*by, *[c.alias(n) for n, c in sums.items()], *[F.array(*corners(a)).alias(f"_{k}") for k, a in enumerate(axes)])
    made = []
    for pick in itertools.product((0, 1), repeat=len(axes)):
        share = F.lit(1.0)
        index = []
        for k, (a, side) in enumerate(zip(axes, pick)):
            share = share * F.col(f"_{k}")[side]["p"]
            index.append(F.col(f"_{k}")[side]["i"].alias(a.out))
        made.append(F.struct(*index, share.alias("share")))
    spread = split.select(*by, *sums, F.inline(F.array(*made))).where("share > 0")
    return spread.groupBy(*by, *[a.out for a in axes]).agg(*[F.sum(F.col(n) * F.col("share")).alias(n) for n in sums])


def bin_nearest(points: DataFrame, axes: list[Axis], sums: dict[str, Column], by: list[str] = ["cell_id"]) -> DataFrame:  # noqa: B006
    """As bin_linear, with all mass in bin min(floor(p * size), size - 1)."""
    index = [F.least(F.floor(_checked(F.col(a.column), a) * float(a.size)), F.lit(a.size - 1)).cast("int").alias(a.out) for a in axes]
    return points.select(*by, *index, *[c.alias(n) for n, c in sums.items()]).groupBy(*by, *[a.out for a in axes]).agg(*[F.sum(n).alias(n) for n in sums])


def square(size: int, **kinds: bool) -> list[Axis]:
    return [Axis("y", size, "iy", **kinds), Axis("x", size, "ix", **kinds)]


def visits_and_counts(points: DataFrame, size: int, weight: Column | None = None, by: list[str] = ["cell_id"], method: str = "linear", **kinds: bool) -> DataFrame:  # noqa: B006
    """n (visits) and k (events) per bin of points with event count s."""
    w = F.lit(1.0) if weight is None else weight
    bins = bin_linear if method == "linear" else bin_nearest
    return bins(points, square(size, **kinds), {"n": w, "k": w * F.col("s")}, by)


def rates(grid: DataFrame) -> DataFrame:
    """Adds y = k / n."""
    return grid.withColumn("y", sdiv(F.col("k"), F.col("n")))


def reweighted(points: DataFrame, size: int, weight: Column, by: list[str] = ["cell_id"]) -> DataFrame:  # noqa: B006
    """Bins again with weights per point; points without weight are skipped."""
    return visits_and_counts(points.where(weight > 0), size, weight, by)


def histogram(values: DataFrame, column: str, low: float, high: float, bins: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Equal-width counts on [low, high]; the top edge is in the last bin, others out of range are skipped."""
    at = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    inside = values.where((F.col(column) >= low) & (F.col(column) <= high))
    return inside.groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def shared_counts(spikes: DataFrame, u: Column, steps: Column, by: list[str]) -> DataFrame:
    """(by, t, count) of events at sample time u, shared between samples floor(u) and floor(u) + 1; mass at `steps` goes to
    the last sample, mass beyond or before 0 is dropped; samples without events are absent."""
    low = F.floor("_u").cast("long")
    two = F.array(F.struct(low.alias("t"), (1 - (F.col("_u") - low)).alias("c")), F.struct((low + 1).alias("t"), (F.col("_u") - low).alias("c")))
    last = F.when(F.col("t") == F.col("_n"), F.col("_n") - 1).otherwise(F.col("t")).cast("long")
    spread = spikes.select(*by, u.alias("_u"), steps.alias("_n")).where("_u >= 0").select(*by, "_n", F.inline(two)).where("t <= _n and c > 0")
    return spread.groupBy(*by, last.alias("t")).agg(F.sum("c").alias("count"))


def spike_counts(spikes: DataFrame, dt: float, steps: int, by: list[str] = ["cell_id"], time: str = "t_sec") -> DataFrame:  # noqa: B006
    """Event times as counts at t = 0..steps-1, shared between the two nearest samples; mass at the closed
    upper edge goes to the last sample, mass beyond is dropped; samples without events count 0."""
    found = shared_counts(spikes, F.col(time) / dt, F.lit(steps), by)
    dense = spikes.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))).alias("t"))
    return dense.join(found, [*by, "t"], "left").select(*by, "t", F.coalesce("count", F.lit(0.0)).alias("count"))
