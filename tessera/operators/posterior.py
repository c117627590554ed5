"""Posterior analysis of fitted maps: sampled and Laplace confidence of fields, profiles, prior draws, scalar fits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import kernels, solver
from tessera.operators import fits, geometry, grids, moments, neighbors
from tessera.operators.fits import _key, _maps, _run, _spectrum
from tessera.runtime import cut, ship

BY = ["cell_id"]


def sampled_peaks(samples: DataFrame, size: int, radius: float, by: list[str] = BY, quantile: float = 0.25) -> DataFrame:
    """Interpolated peaks of every posterior sample (key, sample_id, h, w, z) of square maps, above the sample's quantile."""
    long = grids.unpack(samples, ["z"], [*by, "sample_id"])
    return grids.interpolate_peaks(long, "z", size, size, radius, quantile, [*by, "sample_id"])


def filter_peaks(peaks: DataFrame, planes: DataFrame, edge: float = 0.0, quantile: float = 0.0, least: float | None = None, probability: str = "total", localisation: float | None = None, by: list[str] = BY) -> DataFrame:
    """Peaks (key, x, y, height) at least `edge` inside the key's hull (planes of unit normals) and at or above the quantile of
    the key's heights; with `least`, `probability` at that or above; with `localisation`, the major deviation of their
    covariance (xx, xy, yy) at most that."""
    inside = F.forall("planes", lambda p: p["a"] * F.col("x") + p["b"] * F.col("y") + p["c"] <= -edge + 1e-12)
    low = peaks.groupBy(*by).agg(F.percentile("height", quantile).alias("_low"))
    out = peaks.join(planes, by).where(inside).drop("planes").join(low, by).where(F.col("height") >= F.col("_low")).drop("_low")
    if least is not None:
        out = out.where(F.col(probability) >= least)
    if localisation is not None:
        out = out.where(F.sqrt(geometry.ellipse_axes(F.col("xx"), F.col("xy"), F.col("yy"))["major"]) <= localisation)
    return out


def sampled_confidence(samples: DataFrame, size: int, period: float, least: float = 0.1, by: list[str] = BY, reach: float | None = None, quantile: float = 0.25) -> DataFrame:
    """Fields found in the density of sampled peaks: (key, field, total, mx, my, xx, xy, yy).

    Peaks (local maxima within `reach`, half the period, above the sample's quantile) are binned per sample and averaged, the density is blurred by a tenth of the period, its peaks are the
    fields, every bin within 0.7 periods goes to its closest field, and the density's moments there are the field's
    Gaussian; `total` is the expected number of peaks, and fields below `least` are dropped.
    """
    radius, samples = period / 2 if reach is None else reach, cut(samples)
    count = samples.groupBy(*by).agg(F.countDistinct("sample_id").alias("_s"))
    found = sampled_peaks(samples, size, radius, by, quantile).select(*by, "sample_id", "x", "y").join(count, by)
    density = cut(grids.dense(grids.peak_density(found, F.col("_s"), size, by), size, size, ["n"], by))
    soft = cut(grids.blur(density, ["n"], size, size, max(0.5, period / 10), by))
    fields = grids.interpolate_peaks(soft, "n", size, size, max(1.0, radius / 2), 0.5, by).select(*by, F.col("rank").alias("id"), "x", "y")
    cells = density.where("n > 0").select(*by, ((F.col("ix") + 0.5) / size).alias("x"), ((F.col("iy") + 0.5) / size).alias("y"), F.col("n").alias("weight"))
    dealt = neighbors.voronoi(cells, fields, "id", by, 0.7 * period / size).where("region >= 0")
    return moments.weighted_gaussians(dealt, "weight", [*by, "region"]).withColumnRenamed("region", "field").where(F.col("total") >= least)


def members(peaks: DataFrame, fields: DataFrame, reach: float | None = None, by: list[str] = BY) -> DataFrame:
    """Sampled peaks (key, sample_id, x, y, ...) with `field`, the id of the closest of fields(key, id, x, y); peaks beyond
    `reach` of every field are left out."""
    return neighbors.voronoi(peaks, fields, "id", by, reach).where("region >= 0").withColumnRenamed("region", "field")


def field_statistics(owned: DataFrame, samples: DataFrame, planes: DataFrame | None = None, edge: float = 0.0, least: float = 0.0, localisation: float | None = None, by: list[str] = BY) -> DataFrame:
    """Fields of members(key, field, sample_id, x, y): total (peaks a sample), probability (share of the samples(key, count)
    that have a peak there), mean mx, my and covariance xx, xy, yy of their peaks.

    With planes, fields whose mean lies at least `edge` inside the key's hull; with a probability of at least `least`; with
    `localisation`, of at most that major deviation."""
    moments_ = [F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("xx"), F.covar_pop("x", "y").alias("xy"), F.var_pop("y").alias("yy")]
    per = owned.groupBy(*by, "field").agg(F.count(F.lit(1)).alias("_peaks"), F.countDistinct("sample_id").alias("_held"), *moments_)
    share = [(F.col(c) / F.col("count")).alias(n) for c, n in (("_peaks", "total"), ("_held", "probability"))]
    out = per.join(samples.select(*by, "count"), by).select(*by, "field", *share, "mx", "my", "xx", "xy", "yy").where(F.col("probability") >= least)
    if planes is not None:
        inside = F.forall("planes", lambda p: p["a"] * F.col("mx") + p["b"] * F.col("my") + p["c"] <= -edge + 1e-12)
        out = out.join(planes, by).where(inside).drop("planes")
    if localisation is not None:
        out = out.where(F.sqrt(geometry.ellipse_axes(F.col("xx"), F.col("xy"), F.col("yy"))["major"]) <= localisation)
    return out


def sample_fields(
    samples: DataFrame, size: int, period: float, planes: DataFrame | None = None, radius: float | None = None, edge: float = 0.0, height: float = 0.0, least: float = 0.0, localisation: float | None = None, by: list[str] = BY
) -> tuple[DataFrame, DataFrame]:
    """(fields, members) of posterior samples (key, sample_id, h, w, z) of square maps, in one path from draws to filters.

    Peaks of every sample (local maxima within `radius` bins, 1/2.5 of the period, above the sample's `height` quantile) are
    binned to a density, whose blurred (radius / 7) peaks are the fields' places; every sampled peak belongs to the closest
    place within a period, those outside the hull counting as places too, as they bound the others.  `field_statistics` then
    filters fields by hull and edge, probability and localisation; members are the rows of the peaks of the fields left."""
    radius, samples = period / 2.5 if radius is None else radius, cut(samples)
    counts = cut(samples.groupBy(*by).agg(F.countDistinct("sample_id").alias("count")))
    peaks = cut(sampled_peaks(samples, size, radius, by, height).select(*by, "sample_id", F.col("rank").alias("peak"), "x", "y", "height"))
    density = grids.dense(grids.peak_density(peaks.join(counts, by), F.col("count"), size, by), size, size, ["n"], by)
    soft = cut(grids.blur(density, ["n"], size, size, max(radius / 7, 0.4), by))
    places = grids.interpolate_peaks(soft, "n", size, size, max(1.0, radius), 0.0, by).select(*by, F.col("rank").alias("id"), "x", "y")
    owned = cut(members(peaks, places, period / size, by))
    fields = cut(field_statistics(owned, counts, planes, edge, least, localisation, by))
    return fields, owned.join(fields.select(*by, "field"), [*by, "field"])


#: the fraction of the golden ratio, whose multiples fill the unit interval evenly (fixed value)
GOLDEN = 0.6180339887498949


def fraction_inside(gaussians: DataFrame, planes: DataFrame, draws: int = 200, seed: int = 0, by: list[str] = BY, key: str = "field") -> DataFrame:
    """Share of `draws` points of each Gaussian (key, mx, my, xx, xy, yy) that lies in the key's hull.

    The points are a fixed even sample of the plane's normal distribution (radii at mid-quantiles, angles at multiples of the
    golden section, turned by `seed`), stretched by the Gaussian's triangular root, so the share repeats exactly."""
    i = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_i")
    spread = gaussians.where("mx is not null and xx > 0").join(planes, by).select("*", i)
    turn = F.col("_i") * GOLDEN + seed * 0.1
    angle, radius = (turn - F.floor(turn)) * (2 * math.pi), F.sqrt(F.log((F.col("_i") + 0.5) / draws) * -2)
    u, v = radius * F.cos(angle), radius * F.sin(angle)
    a = F.sqrt("xx")
    b = F.col("xy") / a
    x, y = F.col("mx") + a * u, F.col("my") + b * u + F.sqrt(F.greatest(F.col("yy") - b * b, F.lit(0.0))) * v
    return spread.groupBy(*by, key).agg(F.avg(geometry.in_hull(x, y, F.col("planes")).cast("double")).alias("fraction"))


def joint_confidence(packed: DataFrame, ridge: float = 1e-5, domain: str = "log", by: list[str] = BY) -> DataFrame:
    """Blocks of the joint 2n x 2n covariance of all peaks of a fitted map: (key, a, b, iy, ix, xx, xy, yx, yy) for peaks a, b.

    domain "log": of the log rate's peaks; "rate": Hessians of the mean rate, gradients scaled by rate^2 exp(v).
    """

    def one(row: pd.Series) -> pd.DataFrame:
        n, k = _maps(row)
        spectrum, mean, _ = _spectrum(n, k, row.get("period"), row.get("variance"), row.get("angle"), "radial")
        got = solver.fit(spectrum, n, k, mean)
        z, rate, v = got.log_rate(), got.rate(), got.variance()
        surface = z if domain == "log" else rate
        inner = z[1:-1, 1:-1]
        around = np.stack([z[1 + i : z.shape[0] - 1 + i, 1 + j : z.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
        found = np.argwhere(inner > around.max(axis=0)) + 1
        rows = []
        if len(found):
            scale = 1.0 if domain == "log" else (rate * np.exp(v / 2))[tuple(found.T)][:, None, None]
            # x before y, as in the blocks
            jac = (scale * solver.peak_gradients(got, found)[:, ::-1]).reshape(2 * len(found), -1)
            inv = np.linalg.pinv(-solver.peak_hessians(surface, found)[:, ::-1, ::-1])
            g = jac @ got.factor.T
            h = np.zeros((2 * len(found),) * 2)
            for a, m in enumerate(inv):
                h[2 * a : 2 * a + 2, 2 * a : 2 * a + 2] = m
            s = h @ (g @ g.T) @ h.T + ridge * np.eye(len(h))
            for a in range(len(found)):
                for c in range(len(found)):
                    rows.append([row[x] for x in by] + [a, c, int(found[a][0]), int(found[a][1]), *s[2 * a : 2 * a + 2, 2 * c : 2 * c + 2].ravel().tolist()])
        return pd.DataFrame(rows, columns=[*by, "a", "b", "iy", "ix", "xx", "xy", "yx", "yy"])

    return _run(packed, one, f"{_key(packed, by)}, a int, b int, iy int, ix int, xx double, xy double, yx double, yy double", by)


def heading_quadratic(packed: DataFrame, style: str = "radial", by: list[str] = BY, keep: int = 1000, height: float = 0.0) -> DataFrame:
    """Laplace confidence of the fields at each heading of a joint heading x space fit, of packed(key, d, h, w, n, k):
    (key, layer, peak, iy, ix, log_rate, xx, xy, yy, x_turn, y_turn, links).

    Peaks are local maxima in the plane of their heading, above its `height` quantile.  Covariances (in bins) come from the
    gradient's covariance under the joint fit and the spatial block of the three-dimensional Hessian; x_turn and y_turn
    are how far a peak moves per layer, from the Hessian's block between heading and space.  links: (peak, xx, xy, yx, yy)
    blocks of its covariance with the peaks of the next layer, in row order of that layer."""

    def one(row: pd.Series) -> pd.DataFrame:
        got = fits._joint(row, style, keep)
        z = got.log_rate()
        found, shape = [], z.shape
        for layer in range(shape[0]):
            inner = z[layer, 1:-1, 1:-1]
            around = np.stack([z[layer, 1 + i : shape[1] - 1 + i, 1 + j : shape[2] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
            at = np.argwhere((inner > around.max(axis=0)) & (inner >= np.quantile(z[layer], height))) + 1
            found += [(layer, int(i), int(j)) for i, j in at]
        rows = []
        if found:
            at = np.array(found)
            hessian = solver.peak_hessians(z, at)
            space, cross = hessian[:, 1:, 1:][:, ::-1, ::-1], hessian[:, 1:, 0][:, ::-1]  # x before y
            inverse = np.linalg.pinv(-space)
            turn = np.einsum("pab,pb->pa", inverse, cross)
            g = solver.peak_gradients(got, at)[:, 1:][:, ::-1] @ got.factor.T  # P x 2 x R
            half = inverse @ g
            for p, (layer, iy, ix) in enumerate(found):
                s = half[p] @ half[p].T
                ahead = [q for q, f in enumerate(found) if f[0] == (layer + 1) % shape[0]]
                links = [{"peak": k, **dict(zip(("xx", "xy", "yx", "yy"), (half[p] @ half[q].T).ravel().tolist()))} for k, q in enumerate(ahead)]
                own = sum(f[0] == layer for f in found[:p])
                rows.append([row[x] for x in by] + [layer, own, iy, ix, float(z[layer, iy, ix]), s[0, 0], s[0, 1], s[1, 1], *turn[p].tolist(), links])
        return pd.DataFrame(rows, columns=[*by, "layer", "peak", "iy", "ix", "log_rate", "xx", "xy", "yy", "x_turn", "y_turn", "links"])

    link = "array<struct<peak: int, xx: double, xy: double, yx: double, yy: double>>"
    return _run(packed, one, f"{_key(packed, by)}, layer int, peak int, iy int, ix int, log_rate double, xx double, xy double, yy double, x_turn double, y_turn double, links {link}", by)


def profiles(swept: DataFrame, axis: str, by: list[str] = BY) -> DataFrame:
    """Best elbo per value of one swept parameter, with its difference from the key's best."""
    best = swept.groupBy(*by, axis).agg(F.max("elbo").alias("elbo"))
    return best.withColumn("below_best", F.max("elbo").over(Window.partitionBy(*by)) - F.col("elbo"))


def heading_variance(packed: DataFrame, factors: list[float], period: float, variance: float, angle: float, by: list[str]) -> DataFrame:
    """Scale of the prior variance with the largest elbo for each key (such as cell and direction)."""
    rows = [(k, period, variance * f, angle) for k, f in enumerate(factors)]
    grid = packed.sparkSession.createDataFrame(rows, "param_id long, period double, variance double, angle double")
    return fits.best(fits.sweep(packed, grid, "grid", by), by).withColumn("factor", F.col("variance") / variance)


def heading_density(packed: DataFrame, count: int, size: int, period: float, by: list[str] = BY, seed: int = 0, keep: int = 1000) -> DataFrame:
    """Density of posterior peaks per heading layer: mean number of interpolated peaks (key, layer, iy, ix, n) over draws of
    the joint heading x space fit, local maxima within period / 2.5."""
    keys = [*by, "layer"]
    samples = cut(fits.heading_samples(packed, count, seed, by=by, keep=keep))
    peaks = sampled_peaks(samples, size, period / 2.5, keys)
    return grids.peak_density(peaks.select(*keys, "sample_id", "x", "y"), F.lit(float(count)), size, keys)


def heading_confidence(packed: DataFrame, planes: DataFrame, count: int, size: int, period: float, by: list[str], exclusion: float = 0.4, edge: float = 0.2, height: float = 0.9, probability: float = 0.01, seed: int = 0) -> DataFrame:
    """Confidence of fields per heading: for maps fitted by (key, layer), the sampled fields of `sampled_confidence` that lie
    at least edge * period inside the hull, with `probability` at least; peaks in samples are above the `height` quantile
    and local maxima within exclusion * period."""
    samples = cut(fits.posterior_samples(packed, count, seed, by=by))
    fields = sampled_confidence(samples, size, period, probability, by, exclusion * period, height)
    inside = F.forall("planes", lambda p: p["a"] * F.col("mx") + p["b"] * F.col("my") + p["c"] <= -edge * period / size + 1e-12)
    return fields.join(planes, [k for k in by if k in planes.columns]).where(inside).drop("planes")


def prior_draws(spark, count: int, size: int, period: float, variance: float, angle: float = 0.0, style: str = "grid", seed: int = 0) -> DataFrame:
    """(sample_id, h, w, z): seeded draws of the prior."""
    ship(spark)

    def draw(batches):
        spectrum = np.fft.fft2(kernels.grid_kernel(period, (size, size), style, angle)).real * variance
        for b in batches:
            yield pd.DataFrame({"sample_id": b["id"], "h": size, "w": size, "z": [kernels.draw(spectrum, (seed << 20) + int(i)).ravel() for i in b["id"]]})

    return spark.range(count).mapInPandas(draw, "sample_id long, h int, w int, z array<double>")


def scalar_fits(rows: DataFrame, mean: str, precision: str, count: str, rounds: int = 20) -> DataFrame:
    """Gaussian approximation (mu, v) of a scalar log rate with a normal prior and one Poisson count, by the same
    alternation of Newton steps and variance updates."""
    ship(rows.sparkSession)

    def solve(batches):
        for b in batches:
            m0, p0, y = (b[c].to_numpy(dtype=float) for c in (mean, precision, count))
            mu, v = m0.copy(), 1 / p0
            for _ in range(rounds):
                for _ in range(10):
                    lam = solver.sexp(mu + v / 2)
                    mu = mu - (lam - y + p0 * (mu - m0)) / (lam + p0)
                v = 1 / (p0 + solver.sexp(mu + v / 2))
            yield b.assign(mu=mu, v=v)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(solve, f"{schema}, mu double, v double")


def zero_lag(profile: DataFrame, value: str, reach: int = 3, by: list[str] = BY) -> DataFrame:
    """Value at lag 0 of a quadratic a + b lag^2 fitted by least squares to lags 1..reach of a symmetric profile (key, r, value)."""
    near = profile.where((F.col("r") >= 1) & (F.col("r") <= reach))
    x = F.col("r").cast("double") * F.col("r")
    return near.groupBy(*by).agg(F.regr_intercept(F.col(value), x).alias("zero_lag"))


def box_statistics(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """5, 25, 50, 75 and 95 percent quantiles per group."""
    out = moments.quantiles(values, column, [0.05, 0.25, 0.5, 0.75, 0.95], by)
    return out.select(*by, "n", *[F.col("q")[k].alias(n) for k, n in enumerate(("low", "q1", "median", "q3", "high"))])
