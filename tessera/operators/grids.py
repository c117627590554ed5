"""Fields on grids: packing, blurs, kernel-density rates, correlations, transforms, stencils and peaks.

Long form (key, iy, ix, value) is the SQL path: stencils explode offsets and aggregate, so no theta join appears, and
Gaussian blurs run as two one-dimensional passes.  Packed form (one array a key) feeds the FFT kernels.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.safe import sdiv

BY = ["cell_id"]


def gaussian_taps(size: int, sigma: float, half: bool = True, unit: bool = False) -> list[float]:
    """Periodic Gaussian by distance 0..size-1: exp(-d^2 / (2 sigma^2)), or without the 2; peak 1 or unit sum."""
    d = np.minimum(np.arange(size), size - np.arange(size))
    g = np.exp(-(d**2) / sigma**2 * (0.5 if half else 1.0))
    return (g / g.sum() if unit else g).tolist()


def _shift(grid: DataFrame, index: str, size: int, taps: list[float], values: list[str], by: list[str]) -> DataFrame:
    table = F.array(*[F.struct(F.lit(k).alias("_k"), F.lit(w).alias("_w")) for k, w in enumerate(taps)])
    spread = grid.select("*", F.inline(table)).withColumn(index, ((F.col(index) + F.col("_k")) % size).cast("int"))
    return spread.groupBy(*by, "iy", "ix").agg(*[F.sum(F.col(v) * F.col("_w")).alias(v) for v in values])


def blur(grid: DataFrame, values: list[str], height: int, width: int, sigma: float, by: list[str] = BY, half: bool = True, unit: bool = False) -> DataFrame:
    """Circular Gaussian blur, rows then columns; the result is dense along blurred lines."""
    out = _shift(grid.select(*by, "iy", "ix", *values), "ix", width, gaussian_taps(width, sigma, half, unit), values, by)
    return _shift(out, "iy", height, gaussian_taps(height, sigma, half, unit), values, by)


def _overall_rate(by: list[str]) -> Column:
    """sum k / sum n of a key; a circular blur scales both sums alike, so blurred maps give it without another pass."""
    whole = Window.partitionBy(*by)
    return F.sum("k").over(whole) / F.sum("n").over(whole)


def kde(grid: DataFrame, height: int, width: int, sigma: float, by: list[str] = BY) -> DataFrame:
    """Rate per bin: (blurred k + mean / 2) / (blurred n + 1 / 2), with mean = sum k / sum n of the key."""
    mu = _overall_rate(by)
    return blur(grid, ["n", "k"], height, width, sigma, by).select(*by, "iy", "ix", ((F.col("k") + mu * 0.5) / (F.col("n") + 0.5)).alias("rate"))


def biased_rate(n: Column, k: Column, mean: Column, rho: float = 0.9, gamma: float = 0.5) -> Column:
    """(k + rho * mean + gamma * (1 - rho)) / (n + rho)."""
    return (k + mean * rho + gamma * (1 - rho)) / (n + rho)


def kde_biased(grid: DataFrame, height: int, width: int, sigma: float, by: list[str] = BY, mask: DataFrame | None = None) -> DataFrame:
    """The earlier estimator: unit-sum kernel exp(-d^2 / sigma^2) and `biased_rate`.  With a mask (by, iy, ix), every bin
    of a key's grid outside it has rate 0; the blur itself takes all bins."""
    blurred = blur(grid, ["n", "k"], height, width, sigma, by, half=False, unit=True)
    rates = blurred.select(*by, "iy", "ix", biased_rate(F.col("n"), F.col("k"), _overall_rate(by)).alias("rate"))
    if mask is None:
        return rates
    inside = mask.select(*by, "iy", "ix").distinct().withColumn("_in", F.lit(True))
    return rates.join(inside, [*by, "iy", "ix"], "left").select(*by, "iy", "ix", F.when(F.col("_in"), F.col("rate")).otherwise(0.0).alias("rate"))


def dense(grid: DataFrame, height: int, width: int, values: list[str], by: list[str] = BY) -> DataFrame:
    """All bins of every key; absent ones hold 0."""
    cells = F.array(*[F.struct(F.lit(i).alias("iy"), F.lit(j).alias("ix")) for i in range(height) for j in range(width)]) if height * width <= 1024 else None
    keys = grid.select(*by).distinct()
    if cells is not None:
        full = keys.select(*by, F.inline(cells))
    else:
        at = F.explode(F.sequence(F.lit(0), F.lit(height * width - 1))).alias("_at")
        full = keys.select(*by, at).select(*by, F.floor(F.col("_at") / width).cast("int").alias("iy"), (F.col("_at") % width).cast("int").alias("ix"))
    return full.join(grid, [*by, "iy", "ix"], "left").select(*by, "iy", "ix", *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])


def pack(grid: DataFrame, height: int, width: int, values: list[str], by: list[str] = BY) -> DataFrame:
    """One row per key with a row-major array per value (absent bins 0)."""
    full = dense(grid, height, width, values, by)
    rows = full.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((F.col("iy") * width + F.col("ix")).alias("at"), *values))).alias("cells"))
    return rows.select(*by, F.lit(height).alias("h"), F.lit(width).alias("w"), *[F.col(f"cells.{v}").alias(v) for v in values])


def unpack(packed: DataFrame, values: list[str], by: list[str] = BY) -> DataFrame:
    at = packed.select(*by, "w", F.posexplode(F.arrays_zip(*values)).alias("at", "cell"))
    return at.select(*by, F.floor(F.col("at") / F.col("w")).cast("int").alias("iy"), (F.col("at") % F.col("w")).cast("int").alias("ix"), *[F.col(f"cell.{v}").alias(v) for v in values])


def radial_average(field: DataFrame, value: str, height: int, width: int, by: list[str] = BY) -> DataFrame:
    """Mean by rounded distance from the middle bin (height div 2, width div 2)."""
    r = F.round(F.hypot(F.col("iy") - height // 2, F.col("ix") - width // 2)).cast("int")
    return field.groupBy(*by, r.alias("r")).agg(F.avg(value).alias(value))


def autocorrelation(field: DataFrame, value: str, height: int, width: int, by: list[str] = BY) -> DataFrame:
    """Circular autocorrelation of a dense field less its mean, Hann-tapered on both axes, at lags (dy, dx), scaled so that
    the peak equals the field's variance; zero lag sits at the middle bin.

    The inverse cosine transform of the power spectrum: four one-dimensional passes, so that a bin is spread W and H
    times and not H * W times, and keys do not meet.
    """
    moments = field.groupBy(*by).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_var"))
    hann = lambda i, n: (1 - F.cos(F.col(i) * (2 * math.pi / (n - 1)))) * 0.5
    taper = field.join(moments, by).select(*by, "iy", "ix", ((F.col(value) - F.col("_m")) * hann("iy", height) * hann("ix", width)).alias("v"))
    power = hartley(taper, "v", height, width, by)
    # of a real field, the power at a frequency and at minus it sum to twice |F|^2 / (H W)
    mirrored = power.select(*by, F.pmod(-F.col("ky"), F.lit(height)).alias("ky"), F.pmod(-F.col("kx"), F.lit(width)).alias("kx"), (F.col("c") * F.col("c")).alias("p"))
    power = power.select(*by, "ky", "kx", (F.col("c") * F.col("c")).alias("p")).unionByName(mirrored).groupBy(*by, "ky", "kx").agg((F.sum("p") / 2).alias("p"))
    lags = hartley(power.select(*by, F.col("ky").alias("iy"), F.col("kx").alias("ix"), "p"), "p", height, width, by)
    shift = lambda k, n: F.pmod(F.col(k) + n // 2, F.lit(n)).cast("int")
    sums = lags.select(*by, shift("ky", height).alias("iy"), shift("kx", width).alias("ix"), (F.col("c") * math.sqrt(height * width)).alias("ac"))
    top = Window.partitionBy(*by)
    return sums.join(moments, by).select(*by, "iy", "ix", sdiv(F.col("ac") * F.col("_var"), F.max("ac").over(top)).alias("ac"))


def hartley(field: DataFrame, value: str, height: int, width: int, by: list[str] = BY) -> DataFrame:
    """Orthonormal real transform at (ky, kx): sum of value * (cos - sin)(2 pi (ky y / H + kx x / W)) / sqrt(H W).

    Two one-dimensional passes, rows then columns (cosine and sine sums of each row, then of the columns), so that every
    bin is spread W and then H times, not H * W times.
    """
    def turn(k: str, i: str, n: int) -> Column:
        return (F.col(k) * F.col(i) % n / float(n)) * (2 * math.pi)

    wide = field.select(*by, "iy", "ix", value, F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("kx"))
    a = turn("kx", "ix", width)
    rows = wide.groupBy(*by, "iy", "kx").agg(F.sum(F.col(value) * F.cos(a)).alias("_c"), F.sum(F.col(value) * F.sin(a)).alias("_s"))
    tall = rows.select(*by, "iy", "kx", "_c", "_s", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("ky"))
    b = turn("ky", "iy", height)
    # cos(a + b) - sin(a + b)
    part = F.col("_c") * (F.cos(b) - F.sin(b)) - F.col("_s") * (F.sin(b) + F.cos(b))
    return tall.groupBy(*by, "ky", "kx").agg((F.sum(part) / math.sqrt(height * width)).alias("c"))


def retained(spectrum: DataFrame, value: str, axes: list[str], least: float = 0.1, by: list[str] = BY) -> DataFrame:
    """Rows of a long spectrum (key, axes, value) at `least` of the key's largest value off frequency 0, or above."""
    other = spectrum.where(" or ".join(f"{a} <> 0" for a in axes)).groupBy(*by).agg(F.max(value).alias("_top"))
    return spectrum.join(other, by).where(F.col(value) >= F.col("_top") * least).drop("_top")


def top_frequencies(spectrum: DataFrame, value: str, axes: list[str], count: int, by: list[str] = BY) -> DataFrame:
    """The `count` rows with the largest values per key (ties: lowest axes)."""
    order = Window.partitionBy(*by).orderBy(F.desc(value), *axes)
    return spectrum.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= count).drop("_r")


def _stencil(field: DataFrame, value: str, offsets: dict[str, list[tuple[int, int, float]]], height: int, width: int, by: list[str], wrap: bool = True) -> DataFrame:
    """Weighted sums over neighbours: out[iy, ix] = sum w * value[iy + dy, ix + dx], for several named weight sets."""
    spots = sorted({(dy, dx) for o in offsets.values() for dy, dx, _ in o})
    taps = F.array(*[F.struct(F.lit(dy).alias("_dy"), F.lit(dx).alias("_dx"), *[F.lit(float(sum(w for a, b, w in o if (a, b) == (dy, dx)))).alias(f"_{n}") for n, o in offsets.items()]) for dy, dx in spots])
    spread = field.select(*by, "iy", "ix", value, F.inline(taps))
    iy, ix = F.col("iy") - F.col("_dy"), F.col("ix") - F.col("_dx")
    if wrap:
        iy, ix = F.pmod(iy, F.lit(height)), F.pmod(ix, F.lit(width))
    moved = spread.withColumn("iy", iy.cast("int")).withColumn("ix", ix.cast("int"))
    moved = moved if wrap else moved.where(f"iy between 0 and {height - 1} and ix between 0 and {width - 1}")
    return moved.groupBy(*by, "iy", "ix").agg(*[F.sum(F.col(value) * F.col(f"_{n}")).alias(n) for n in offsets])


def hessian(field: DataFrame, value: str, height: int, width: int, by: list[str] = BY) -> DataFrame:
    """Circular second derivatives from central differences applied twice: xx, xy, yy."""
    second = lambda y: [((2, 0) if y else (0, 2)), (0, 0), ((-2, 0) if y else (0, -2))]
    weights = [0.25, -0.5, 0.25]
    sets = {
        "xx": [(*o, w) for o, w in zip(second(False), weights)],
        "xy": [(1, 1, 0.25), (-1, -1, 0.25), (1, -1, -0.25), (-1, 1, -0.25)],
        "yy": [(*o, w) for o, w in zip(second(True), weights)],
    }
    return _stencil(field, value, sets, height, width, by)


def find_peaks(field: DataFrame, value: str, height: int, width: int, radius: float = 1.0, threshold: float | None = None, by: list[str] = BY) -> DataFrame:
    """Bins of a dense field above all bins within `radius` (at least 1); bins beyond the grid count as 0."""
    r = max(1.0, radius)
    m = math.floor(r)
    around = [(i, j) for i in range(-m, m + 1) for j in range(-m, m + 1) if 0 < i * i + j * j <= r * r]
    taps = F.array(*[F.struct(F.lit(i).alias("_dy"), F.lit(j).alias("_dx")) for i, j in around])
    spread = field.select(*by, "iy", "ix", F.col(value).alias("_v"), F.inline(taps))
    sent = spread.select(*by, (F.col("iy") + F.col("_dy")).alias("iy"), (F.col("ix") + F.col("_dx")).alias("ix"), "_v")
    best = sent.groupBy(*by, "iy", "ix").agg(F.max("_v").alias("_top"), F.count(F.lit(1)).alias("_seen"))
    top = F.when(F.col("_seen") < len(around), F.greatest("_top", F.lit(0.0))).otherwise(F.col("_top"))
    out = field.join(best, [*by, "iy", "ix"]).where(F.col(value) > top)
    out = out if threshold is None else out.where(F.col(value) > threshold)
    return out.select(*by, "iy", "ix", value)


def dithered(field: DataFrame, value: str, share: float = 1e-12, by: list[str] = BY) -> DataFrame:
    """Values with a hash of the bin in [-1/2, 1/2) times `share` of the key's largest absolute value added, so that plateaus
    have one top; the same on every run."""
    top = field.groupBy(*by).agg(F.max(F.abs(value)).alias("_top"))
    noise = F.xxhash64(*by, "iy", "ix") / 2.0**64
    return field.join(top, by).withColumn(value, F.col(value) + noise * F.col("_top") * share).drop("_top")


def interpolate_peaks(field: DataFrame, value: str, height: int, width: int, radius: float = 1.0, quantile: float = 0.25, by: list[str] = BY, dither: float = 0.0) -> DataFrame:
    """Peaks above the key's quantile, refined by a quadratic through the edge-clamped 3 x 3 neighbourhood:
    x, y in the unit square (bin + 1/2 less the offset, over the size), height, and rank by falling height.  `dither`: the
    share by which `dithered` parts equal values first."""
    if dither:
        field = dithered(field, value, dither, by)
    peaks = find_peaks(field, value, height, width, radius, None, by)
    low = field.groupBy(*by).agg(F.percentile(value, quantile).alias("_low"))
    peaks = peaks.join(low, by).where(F.col(value) > F.col("_low")).drop("_low", value)
    spots = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    clamp = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    taps = F.array(*[F.struct(F.lit(f"{i}{j}").alias("_s"), clamp(F.col("iy") + i, height).alias("_y"), clamp(F.col("ix") + j, width).alias("_x")) for i, j in spots])
    asked = peaks.select(*by, "iy", "ix", F.inline(taps))
    cells = field.select(*by, F.col("iy").alias("_y"), F.col("ix").alias("_x"), F.col(value).alias("_v"))
    near = asked.join(cells, [*by, "_y", "_x"])
    row = near.groupBy(*by, "iy", "ix").agg(*[F.max(F.when(F.col("_s") == f"{i}{j}", F.col("_v"))).alias(f"q{k}") for k, (i, j) in enumerate(spots)])
    q = [F.col(f"q{k}") for k in range(9)]
    dx, dy = (q[5] - q[3]) / 2, (q[7] - q[1]) / 2
    xx, yy = q[5] - q[4] * 2 + q[3], q[7] - q[4] * 2 + q[1]
    xy = (q[8] - q[6] - q[2] + q[0]) / 4
    det = xx * yy - xy * xy
    ox, oy = sdiv(yy * dx - xy * dy, det), sdiv(xx * dy - xy * dx, det)
    x = (F.col("ix") - ox + 0.5) / width
    y = (F.col("iy") - oy + 0.5) / height
    top = q[4] - (dx * ox + dy * oy) / 2
    out = row.select(*by, "iy", "ix", x.alias("x"), y.alias("y"), top.alias("height")).where((F.col("x").between(0, 1 - 1 / width)) & (F.col("y").between(0, 1 - 1 / height)))
    order = Window.partitionBy(*by).orderBy(F.desc("height"), "iy", "ix")
    return out.withColumn("rank", F.row_number().over(order).cast("long"))


def peak_density(peaks: DataFrame, samples: Column, size: int, by: list[str] = BY) -> DataFrame:
    """Mean number of interpolated peaks per bin over posterior samples."""
    from tessera.operators.binning import bin_linear, square

    return bin_linear(peaks, square(size), {"n": 1 / samples}, by)
