"""Ordered series: runs, gaps, glitches, filters, folds and resampling.

Every operator works within `by` and orders by t explicitly.  One window sort
per operator; frames are bounded wherever the semantics allow.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import savgol

BY = ["cell_id"]


def run_edges(series: DataFrame, flag: Column, by: list[str] = BY, pad: bool = True) -> DataFrame:
    """(start, stop) of runs of consecutive rows with the flag, stop exclusive; pad=False drops runs that touch an end."""
    order = Window.partitionBy(*by).orderBy("t")
    whole = Window.partitionBy(*by)
    marked = series.select(*by, "t", F.coalesce(flag, F.lit(False)).alias("f"))
    marked = marked.withColumn("change", F.when(F.lag("f").over(order).eqNullSafe(F.col("f")), 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("change").over(order)).withColumn("lo", F.min("t").over(whole)).withColumn("hi", F.max("t").over(whole))
    runs = marked.where("f").groupBy(*by, "run").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("stop"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    runs = runs if pad else runs.where("start > lo and stop <= hi")
    return runs.select(*by, "start", "stop")


def fill_gaps(series: DataFrame, columns: list[str], by: list[str] = BY, mode: str = "compat") -> DataFrame:
    """Nulls of each column filled along t.

    compat: a gap of rows s..e-1 between good rows s-1 and e gets g0 + (g1 - g0) * (i - s) / (e - s), so it starts at
    the last good value; a leading gap and the first good row take the value after that row where there is one,
    a trailing gap the last good value.  linear: plain interpolation, ends held.  All null stays null.
    """
    before = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    order = Window.partitionBy(*by).orderBy("t")
    out = series.withColumn("_i", F.row_number().over(order))
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.col("_i"))
        out = out.withColumn("_p", F.max(at).over(before)).withColumn("_n", F.min(at).over(after))
        out = out.withColumn("_pv", F.last(c, ignorenulls=True).over(before)).withColumn("_nv", F.first(c, ignorenulls=True).over(after))
        out = out.withColumn("_follow", F.lead(c).over(order)).withColumn("_led", F.lag(c).over(order))
        share = (F.col("_i") - F.col("_p") - (1 if mode == "compat" else 0)) / (F.col("_n") - F.col("_p") - (1 if mode == "compat" else 0)).cast("double")
        inner = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * share
        filled = F.when(F.col(c).isNotNull(), F.col(c)).when(F.col("_p").isNull(), F.col("_nv")).when(F.col("_n").isNull(), F.col("_pv")).otherwise(inner)
        if mode == "compat":
            # the leading gap reads one row past its end, and that row is overwritten too
            first = F.min(at).over(Window.partitionBy(*by))
            out = out.withColumn("_first", first)
            lead_value = F.max(F.when(F.col("_i") == F.col("_first"), F.coalesce(F.col("_follow"), F.col(c)))).over(Window.partitionBy(*by))
            filled = F.when((F.col("_first") > 1) & (F.col("_i") <= F.col("_first")), lead_value).otherwise(filled)
        out = out.withColumn(f"_{c}", filled)
    for c in columns:
        out = out.withColumn(c, F.col(f"_{c}"))
    return out.select(*series.columns)


def patch_glitches(series: DataFrame, threshold: float | Column, by: list[str] = BY, mode: str = "compat") -> DataFrame:
    """x and y missing where the step to the next row exceeds the threshold (a number or a column), then filled."""
    order = Window.partitionBy(*by).orderBy("t")
    step = F.hypot(F.lead("x").over(order) - F.col("x"), F.lead("y").over(order) - F.col("y"))
    bad = F.coalesce(step > threshold, F.lit(False))
    marked = series.withColumn("_bad", bad)
    for c in ("x", "y"):
        marked = marked.withColumn(c, F.when(~F.col("_bad"), F.col(c)))
    return fill_gaps(marked.drop("_bad"), ["x", "y"], by, mode)


def fir_all(series: DataFrame, filters: dict[str, tuple[str, np.ndarray]], by: list[str] = BY, reflect: str = "even") -> DataFrame:
    """Adds, for every out: (column, weights of lags -m..m), the sum of weight * value at t + lag, rows beyond an end reflected.

    even: x[-i] = x[i]; odd: x[-i] = 2 x[0] - x[i].  Rows must be numbered 0..T-1 in t; a null within reach gives null.
    Series of at most m rows repeat their far end.  One window sort for all filters, frames of 2m + 1 rows.
    """
    whole = Window.partitionBy(*by)
    wide = series.withColumn("_n", F.count(F.lit(1)).over(whole))
    for k, (c, w) in enumerate(filters.values()):
        m = (len(w) - 1) // 2
        frame = Window.partitionBy(*by).orderBy("t").rowsBetween(-m, m)
        wide = wide.withColumn(f"_v{k}", F.collect_list(F.coalesce(F.col(c), F.lit(float("nan")))).over(frame))
    for k, (out, (_, w)) in enumerate(filters.items()):
        m = (len(w) - 1) // 2
        last, low = F.col("_n") - 1, F.greatest(F.lit(0), F.col("t") - m)
        at = lambda index, k=k, low=low: F.element_at(f"_v{k}", (index - low + 1).cast("int"))
        total = F.lit(0.0)
        # last lag first, as DuckDB adds them: where a sum cancels, the sign of what rounding leaves decides an angle
        for lag, x in reversed(list(zip(range(-m, m + 1), w.tolist()))):
            here = F.col("t") + lag
            inside = F.when(here < 0, -here).when(here > last, 2 * last - here).otherwise(here)
            value = at(F.greatest(F.lit(0), F.least(last, inside)))
            if reflect == "odd":
                value = F.when(here < 0, at(F.lit(0)) * 2 - value).when(here > last, at(last) * 2 - value).otherwise(value)
            total = total + value * F.lit(x)
        wide = wide.withColumn(out, total)
    return wide.select(*series.columns, *[F.when(~F.isnan(o), F.col(o)).alias(o) for o in filters])


def fir(series: DataFrame, column: str, weights: np.ndarray, out: str, by: list[str] = BY, reflect: str = "even") -> DataFrame:
    return fir_all(series, {out: (column, weights)}, by, reflect)


def smooth(series: DataFrame, column: str, out: str, m: int, degree: int, by: list[str] = BY) -> DataFrame:
    return fir(series, column, savgol.weights(m, degree), out, by, "even")


def differentiate(series: DataFrame, column: str, out: str, m: int, degree: int, fs: float, derivative: int = 1, by: list[str] = BY) -> DataFrame:
    """Smoothed derivative of order 1 (velocity), 2 (acceleration) or 3 (jerk), in units a second."""
    return fir(series, column, savgol.weights(m, degree, derivative) * fs**derivative, out, by, "odd")


def heading_angle(series: DataFrame, m: int, degree: int, fs: float, by: list[str] = BY) -> DataFrame:
    """Adds heading, the direction of the smoothed velocity of x and y."""
    w = savgol.weights(m, degree, 1) * fs
    return fir_all(series, {"_dx": ("x", w), "_dy": ("y", w)}, by, "odd").withColumn("heading", F.atan2("_dy", "_dx")).drop("_dx", "_dy")


def head_direction(series: DataFrame, degrees: str, m: int, degree: int, by: list[str] = BY) -> DataFrame:
    """Adds direction, the angle of the smoothed cosine and sine of minus the given degrees."""
    angled = series.withColumn("_c", F.cos(F.radians(-F.col(degrees)))).withColumn("_s", F.sin(F.radians(-F.col(degrees))))
    out = smooth(smooth(angled, "_c", "_cs", m, degree, by), "_s", "_ss", m, degree, by)
    return out.withColumn("direction", F.atan2("_ss", "_cs")).drop("_c", "_s", "_cs", "_ss")


def fold_of(t: Column, length: Column | int, k: int) -> Column:
    """Contiguous fold 0..k-1 of row t of a series of that length: floor(t * k / length)."""
    length = length if isinstance(length, Column) else F.lit(length)
    return F.least(F.floor(t * k / length), F.lit(k - 1)).cast("int")


def cross_validation(series: DataFrame, k: int, by: list[str] = BY) -> DataFrame:
    """Every row once a fold, with `fold` and `is_test`."""
    counted = series.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    own = fold_of(F.col("t"), F.col("_n"), k)
    return counted.withColumn("_own", own).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("is_test", F.col("_own") == F.col("fold")).drop("_n", "_own")


def edge_folds(series: DataFrame, k: int, by: list[str] = BY) -> DataFrame:
    """Every row once a fold, with `fold` and `is_test`: fold f tests rows T f / k to T (f + 1) / k, both ends included (so
    neighbours share a row), and trains on the rest."""
    counted = series.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    edge = lambda f: F.floor(F.col("_n") * f / k)
    return counted.withColumn("is_test", F.col("t").between(edge(F.col("fold")), edge(F.col("fold") + 1))).drop("_n")


def resample_blocks(series: DataFrame, draws: DataFrame, length: int, by: list[str] = BY) -> DataFrame:
    """Block bootstrap: draws(sample_id, pos, block_id) lays blocks of `length` rows end to end; `pos_t` is the new time."""
    blocks = series.withColumn("block_id", F.floor(F.col("t") / length).cast("long"))
    return blocks.join(draws, "block_id").withColumn("pos_t", F.col("pos") * length + F.col("t") % length).drop("block_id", "pos")


def random_draws(spark, samples: int, blocks: int, replace: bool = True, seed: int = 0) -> DataFrame:
    """Seeded draw table (sample_id, pos, block_id): blocks + 1 draws with replacement, else a permutation."""
    r = np.random.default_rng(seed)
    rows = []
    for s in range(samples):
        picks = r.integers(0, blocks, blocks + 1) if replace else r.permutation(blocks)
        rows += [(s, p, int(b)) for p, b in enumerate(picks)]
    return spark.createDataFrame(rows, "sample_id long, pos long, block_id long")


#: a prime below 2**31 and multipliers of the draws' hash (fixed values); every product stays below 2**62
PRIME, STEP_A, STEP_B, STEP_C = 2147483647, 48271, 16807, 69621


def drawn_block(sample: Column, pos: Column, blocks: int, seed: int = 0) -> Column:
    """Block 0..blocks-1 that resample `sample` takes at position `pos`: two rounds of multiply and square modulo a prime,
    so any SQL engine draws the same."""
    square = lambda v: F.element_at(F.transform(F.array(v), lambda t: t * t % PRIME), 1)
    first = square((F.lit((seed + 1) * STEP_A % PRIME).cast("long") + sample) % PRIME * STEP_B % PRIME)
    second = square((first + pos) % PRIME * STEP_C % PRIME)
    return F.floor(F.floor((second * STEP_A + 11) % PRIME / 1024) % blocks).cast("long")


def bootstrap_weights(spark, samples: int, blocks: int, seed: int = 0, extra: int = 1) -> DataFrame:
    """(sample_id, block_id, weight): how often each of `samples` resamples takes a block in blocks + extra draws with
    replacement; blocks that it does not take have no row."""
    draws = spark.range(samples * (blocks + extra)).select(F.floor(F.col("id") / (blocks + extra)).alias("sample_id"), (F.col("id") % (blocks + extra)).alias("pos"))
    taken = draws.select("sample_id", drawn_block(F.col("sample_id"), F.col("pos"), blocks, seed).alias("block_id"))
    return taken.groupBy("sample_id", "block_id").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def bootstrap_maps(block_maps: DataFrame, weights: DataFrame, sums: list[str], by: list[str] = BY) -> DataFrame:
    """Sums per key, sample and bin of resamples of block_maps(key, block_id, iy, ix, sums...) under bootstrap weights.

    Binning is linear in its samples, so a resample is a weighted sum of maps that were binned once a block: samples are
    read once and never copied, whatever the number of resamples."""
    met = block_maps.join(weights, "block_id")
    return met.groupBy(*by, "sample_id", "iy", "ix").agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in sums])


def prefixes(series: DataFrame, lengths: list[int]) -> DataFrame:
    """Every row once for each prefix length that holds it (learning curves)."""
    return series.withColumn("used", F.explode(F.array(*[F.lit(x) for x in lengths]))).where("t < used")


def circular_smooth(values: DataFrame, sigma: float, size: int, by: list[str] = BY) -> DataFrame:
    """Periodic Gaussian blur (unit sum) of v over index i in 0..size-1, by an equi-join on shifted indices."""
    d = [min(k, size - k) for k in range(size)]
    g = np.exp(-0.5 * (np.array(d) / sigma) ** 2)
    taps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(w)).alias("g")) for k, w in enumerate(g / g.sum())])
    spread = values.select(*by, "i", "v", F.inline(taps)).withColumn("i", ((F.col("i") + F.col("k")) % size).cast("int"))
    return spread.groupBy(*by, "i").agg(F.sum(F.col("v") * F.col("g")).alias("v"))


def upsample(values: DataFrame, size: int, factor: int, circular: bool = False, by: list[str] = BY) -> DataFrame:
    """v over i in 0..size-1 interpolated to `factor` times as many places by its Hann-tapered spectrum: periodic, or of the
    profile mirrored at its start (the half that is the profile).  Absent places count as 0.

    Interpolation is linear, so every value is spread by the weights of one table and summed: no key meets one task whole."""
    n = size if circular else 2 * size
    k = np.arange(n) - n // 2
    weights = (np.hanning(n) * np.cos(2 * np.pi * np.outer(np.arange(n * factor), k) / (n * factor))).sum(axis=1) / n
    first = 0 if circular else size * factor  # outputs before it are the mirror's
    at = [F.col("i")] if circular else [F.col("i") + size, F.lit(size - 1) - F.col("i")]
    placed = values.select(*by, F.explode(F.array(*at)).alias("_at"), "v")
    taps = F.array(*[F.struct(F.lit(o).alias("_o"), F.lit(float(g)).alias("_g")) for o, g in enumerate(weights)])
    spread = placed.select(*by, "v", "_at", F.inline(taps)).withColumn("i", ((F.col("_at") * factor + F.col("_o")) % (n * factor) - first).cast("int"))
    return spread.where("i >= 0").groupBy(*by, "i").agg(F.sum(F.col("v") * F.col("_g")).alias("v"))
