"""Variational fits over many keys and parameter settings: one task group per fit, packed arrays in, rows out."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import kernels, numerics, solver
from tessera.runtime import cut, ship

BY = ["cell_id"]


def _maps(row: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    shape = (int(row["h"]), int(row["w"]))
    return np.asarray(row["n"], dtype=float).reshape(shape), np.asarray(row["k"], dtype=float).reshape(shape)


def _spectrum(n: np.ndarray, k: np.ndarray, period, variance, angle, style: str) -> tuple[np.ndarray, np.ndarray, tuple[float, float, float]]:
    p, v, a, mean = solver.heuristics(n, k)
    p, v, a = (float(x) if x is not None and np.isfinite(x) else y for x, y in ((period, p), (variance, v), (angle, a)))
    spectrum = kernels.banded_spectrum(n.shape, p, v)[0] if style == "banded" else kernels.spectrum(n.shape, p, v, a, style)
    return spectrum, mean, (p, v, a)


def _run(packed: DataFrame, per_row, schema: str, by: list[str]) -> DataFrame:
    """per_row(row) -> rows; every packed row is one group, so fits spread over tasks."""
    ship(packed.sparkSession)

    def groups(batches: Iterable[pd.DataFrame]):
        for batch in batches:
            for _, row in batch.iterrows():
                yield per_row(row)

    parts = max(1, int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return packed.repartition(parts, *by).mapInPandas(groups, schema)


def _key(packed: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{k} {packed.schema[k].dataType.simpleString()}" for k in by)


def fit_maps(packed: DataFrame, style: str = "radial", by: list[str] = BY) -> DataFrame:
    """Fits of packed(key, h, w, n, k[, period, variance, angle, start]): elbo, period, variance, angle, rounds, and arrays rate,
    log_rate, log_var.  style: of `kernels.grid_kernel`, or "banded" for `kernels.banded_spectrum`.  `start`: an array of h * w, the log rate less the prior mean to begin with."""

    def one(row: pd.Series) -> pd.DataFrame:
        n, k = _maps(row)
        spectrum, mean, (p, v, a) = _spectrum(n, k, row.get("period"), row.get("variance"), row.get("angle"), style)
        start = row.get("start")
        first = None if start is None else solver.Waves(spectrum > 0).weights(np.asarray(start, dtype=float).reshape(n.shape))
        got = solver.fit(spectrum, n, k, mean, start=first)
        out = {x: [row[x]] for x in by} | {"h": [n.shape[0]], "w": [n.shape[1]], "elbo": [got.elbo], "period": [p], "variance": [v], "angle": [a], "rounds": [got.rounds]}
        out |= {"rate": [got.rate().ravel()], "log_rate": [got.log_rate().ravel()], "log_var": [got.variance().ravel()]}
        return pd.DataFrame(out)

    schema = f"{_key(packed, by)}, h int, w int, elbo double, period double, variance double, angle double, rounds int, rate array<double>, log_rate array<double>, log_var array<double>"
    return _run(packed, one, schema, by)


CHUNK = 16


def pack_mask(kept: np.ndarray) -> bytes:
    """A mask of frequencies, eight a byte."""
    return np.packbits(kept).tobytes()


def unpack_mask(packed: bytes, shape: tuple[int, ...]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=int(np.prod(shape))).astype(bool).reshape(shape)


def frequency_words(grid: DataFrame, shapes: list[tuple[int, int]], style: str) -> DataFrame:
    """(shape: its number, pos, word): the union over grid(period, variance, angle) of the frequencies that the settings keep
    on each shape, 64 a word: tasks unite their own settings, an aggregation by bits unites the tasks."""
    ship(grid.sparkSession)

    def unite(batches: Iterable[pd.DataFrame]):
        own: list = [None] * len(shapes)
        for batch in batches:
            for p, v, a in zip(batch["period"], batch["variance"], batch["angle"]):
                for i, shape in enumerate(shapes):
                    mask = kernels.spectrum(shape, p, v, a, style) > 0
                    own[i] = mask if own[i] is None else own[i] | mask
        for i, mask in enumerate(own):
            if mask is not None:
                bits = np.packbits(mask)
                words = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)]).view(np.int64)
                yield pd.DataFrame({"shape": i, "pos": np.arange(len(words)), "word": words})

    parts = int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    settings = grid.select("period", "variance", "angle").repartition(parts)
    return settings.mapInPandas(unite, "shape int, pos int, word long").groupBy("shape", "pos").agg(F.bit_or("word").alias("word"))


def shared_frequencies(grid: DataFrame, shapes: list[tuple[int, int]], style: str) -> dict[tuple[int, int], np.ndarray]:
    """The united masks of `frequency_words` by shape (a bit a bin is collected); an error where one keeps more frequencies
    than the solver takes."""
    words: dict[int, list[tuple[int, int]]] = {i: [] for i in range(len(shapes))}
    for r in frequency_words(grid, shapes, style).collect():
        words[r["shape"]].append((r["pos"], r["word"]))
    kept = {shape: unpack_mask(np.array([w for _, w in sorted(words[i])], np.int64).tobytes(), shape) for i, shape in enumerate(shapes)}
    for shape, mask in kept.items():
        if mask.sum() > solver.LIMIT:
            raise ValueError(f"the settings keep {int(mask.sum())} frequencies on a {shape[0]} x {shape[1]} grid, more than {solver.LIMIT}")
    return kept


def _on(kept: np.ndarray, period: float, variance: float, angle: float, style: str) -> np.ndarray:
    """Spectrum on given frequencies."""
    return np.where(kept, np.maximum(kernels.spectrum(kept.shape, period, variance, angle, style, kept=kept), 1e-9), 0)


def sweep(packed: DataFrame, grid: DataFrame, style: str = "radial", by: list[str] = BY, warm: bool = False) -> DataFrame:
    """elbo of every key and parameter row of grid(param_id, period, variance, angle), on one set of frequencies, so that
    scores compare: packed's column `kept` (of `pack_mask`) where it is there, else the union over the grid by map shape.
    A null in the grid stands for the key's own value in packed(period, variance, angle), and needs `kept`.

    The grid is collected: it is a list of settings.  A map is shipped once for each chunk of settings: of CHUNK, or of
    fewer where there are too few maps to fill the tasks.  `warm`: fits of a chunk start from the one before (scores then
    differ between chunkings by what the solver's tolerance leaves)."""
    settings = sorted(((r["param_id"], r["period"], r["variance"], r["angle"]) for r in grid.collect()), key=lambda x: x[0])
    if not settings:
        raise ValueError("no settings to sweep")
    own = "kept" in packed.columns
    if not own and any(x is None for row in settings for x in row):
        raise ValueError("settings of the keys' own need their frequencies in `kept`")
    shapes = {(r["h"], r["w"]): r["count"] for r in packed.groupBy("h", "w").count().collect()}  # a few
    masks = {} if own else shared_frequencies(grid, sorted(shapes), style)
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(-(-len(settings) // CHUNK), -(-4 * parts // max(1, sum(shapes.values()))))
    size = -(-len(settings) // min(len(settings), wanted))

    def one(row: pd.Series) -> pd.DataFrame:
        n, k = _maps(row)
        _, _, _, mean = solver.heuristics(n, k)
        kept = unpack_mask(row["kept"], n.shape) if own else masks[n.shape]
        chosen = [(i, *(row[c] if x is None else x for c, x in (("period", p), ("variance", v), ("angle", a)))) for i, p, v, a in settings[row["_chunk"] * size : (row["_chunk"] + 1) * size]]
        found, state = [], None
        for _, p, v, a in chosen:
            got = solver.fit(_on(kept, p, v, a, style), n, k, mean, start=state)
            found.append(got.elbo)
            state = got.state() if warm else None
        ids, p, v, a = zip(*chosen)
        return pd.DataFrame({x: [row[x]] * len(chosen) for x in by} | {"param_id": ids, "period": p, "variance": v, "angle": a, "elbo": found})

    chunks = packed.sparkSession.range(-(-len(settings) // size)).withColumnRenamed("id", "_chunk")  # fewer rows than settings
    crossed = packed.crossJoin(F.broadcast(chunks))
    return _run(crossed, one, f"{_key(packed, by)}, param_id long, period double, variance double, angle double, elbo double", [*by, "_chunk"])


def best(swept: DataFrame, by: list[str] = BY) -> DataFrame:
    """The setting with the largest elbo per key (ties: lowest param_id)."""
    order = Window.partitionBy(*by).orderBy(F.desc("elbo"), "param_id")
    return swept.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def climb(packed: DataFrame, periods: list[float] | None, variances: list[float] | None, style: str = "radial", by: list[str] = BY, warm: bool = True) -> DataFrame:
    """Hill climb per key over a period x variance grid: best setting, its elbo, the number of fits made and of their mean
    steps.  Lists that are None are the key's own arrays `periods` and `variances`; packed may have `kept`, the frequencies
    of all fits of a key, and `angle`.  `warm`: each fit starts from the one that the climb comes from."""

    def one(row: pd.Series) -> pd.DataFrame:
        n, k = _maps(row)
        _, _, _, mean = solver.heuristics(n, k)
        ps, vs = (list(row[c]) if x is None else x for c, x in (("periods", periods), ("variances", variances)))
        kept = unpack_mask(row["kept"], n.shape) if "kept" in row else None
        angle = float(row["angle"]) if "angle" in row and row["angle"] is not None else 0.0
        steps = [0]

        def score(at: tuple[int, int], state):
            p, v = ps[at[0]], vs[at[1]]
            try:
                got = solver.fit(kernels.spectrum(n.shape, p, v, angle, style) if kept is None else _on(kept, p, v, angle, style), n, k, mean, start=state)
            except (np.linalg.LinAlgError, ValueError):
                return float("-inf"), None
            steps[0] += got.steps
            return got.elbo, got.state() if warm else None

        at, seen = solver.hill_climb((len(ps), len(vs)), score, carry=True)
        return pd.DataFrame({x: [row[x]] for x in by} | {"period": [ps[at[0]]], "variance": [vs[at[1]]], "elbo": [seen[at]], "fits": [len(seen)], "steps": [steps[0]]})

    return _run(packed, one, f"{_key(packed, by)}, period double, variance double, elbo double, fits int, steps int", by)


def log_grid(centre: float, ratio: float, count: int) -> list[float]:
    """`count` values from centre / ratio to centre * ratio, evenly in the logarithm."""
    return np.exp(np.linspace(np.log(centre / ratio), np.log(centre * ratio), count)).tolist()


def optimise(packed: DataFrame, periods: list[float], variances: list[float], angles: list[float], by: list[str] = BY, oriented: bool = False) -> DataFrame:
    """Period and variance by a radial sweep, then the angle by an oriented one, all keys at once; `oriented`: a third
    stage sweeps period and variance again with the oriented kernel at each key's angle.  All stages use the frequencies that
    the first one's settings keep, so that their bounds compare, and ship a map once for a chunk of settings."""
    spark = packed.sparkSession
    schema = "param_id long, period double, variance double, angle double"
    first = spark.createDataFrame([(i * len(variances) + j, p, v, 0.0) for i, p in enumerate(periods) for j, v in enumerate(variances)], schema)
    shapes = [(r["h"], r["w"]) for r in packed.select("h", "w").distinct().collect()]  # a few
    masks = [(h, w, pack_mask(m)) for (h, w), m in shared_frequencies(first, shapes, "radial").items()]
    kept = packed.drop("kept", "period", "variance", "angle").join(F.broadcast(spark.createDataFrame(masks, "h int, w int, kept binary")), ["h", "w"])
    chosen = ["period", "variance", "angle"]
    top = best(sweep(kept, first, "radial", by), by).select(*by, *chosen)
    turns = spark.createDataFrame([(i, None, None, a) for i, a in enumerate(angles)], schema)
    got = best(sweep(kept.join(top, by), turns, "grid", by), by).select(*by, "param_id", *chosen, "elbo")
    if not oriented:
        return got
    again = first.withColumn("angle", F.lit(None).cast("double"))
    return best(sweep(kept.join(got.select(*by, *chosen), by), again, "grid", by), by).select(*by, "param_id", *chosen, "elbo")


def hyperparameters(packed: DataFrame, period_ratio: float = 1.5, variance_ratio: float = 10.0, periods: int = 101, variances: int = 101, angles: int = 60, by: list[str] = BY, warm: bool = True) -> DataFrame:
    """Period, variance and angle per key around its own heuristics, in three stages on one set of frequencies: a radial
    climb over period and variance, a sweep of angles in [0, 60 degrees), and an oriented climb at the best angle.

    The set is the union of what the radial kernel keeps at each period and at each variance of the key's grid.  Returns
    key, period, variance, angle, elbo, frequencies, fits and error: null, or why a key has no result (too many frequencies).
    Meant for `recordings.resume`, which keeps what is done and computes the rest."""

    def centre(row: pd.Series) -> pd.DataFrame:
        n, k = _maps(row)
        p, v, a, _ = solver.heuristics(n, k)
        ps, vs = log_grid(p, period_ratio, periods), log_grid(v, variance_ratio, variances)
        kept = np.zeros(n.shape, dtype=bool)
        for x in ps:
            kept |= kernels.spectrum(n.shape, max(x, 2.0), v) > 0
        for x in vs:
            kept |= kernels.spectrum(n.shape, p, x) > 0
        count = int(kept.sum())
        error = None if count <= solver.LIMIT else f"{count} frequencies are kept, more than {solver.LIMIT}"
        out = {x: [row[x]] for x in [*by, "h", "w", "n", "k"]} | {"periods": [ps], "variances": [vs], "kept": [pack_mask(kept)], "frequencies": [count], "error": [error]}
        return pd.DataFrame(out)

    array = "array<double>"
    whole = cut(_run(packed, centre, f"{_key(packed, by)}, h int, w int, n {array}, k {array}, periods {array}, variances {array}, kept binary, frequencies int, error string", by))
    able = whole.where("error is null").drop("error")
    first = cut(climb(able, None, None, "radial", by, warm))
    turns = packed.sparkSession.createDataFrame([(i, None, None, i * np.pi / 3 / angles) for i in range(angles)], "param_id long, period double, variance double, angle double")
    turned = cut(best(sweep(able.join(first.select(*by, "period", "variance").withColumn("angle", F.lit(0.0)), by), turns, "grid", by), by).select(*by, "angle"))
    last = climb(able.join(turned, by), None, None, "grid", by, warm).join(turned, by).join(first.select(*by, F.col("fits").alias("_first")), by)
    found = last.select(*by, "period", "variance", "angle", "elbo", (F.col("fits") + F.col("_first") + angles).alias("fits"))
    return whole.select(*by, "frequencies", "error").join(found, by, "left").select(*by, "period", "variance", "angle", "elbo", "frequencies", "fits", "error")


def fit_series(packed: DataFrame, order: str, style: str = "radial", by: list[str] = BY, warm: bool = True) -> DataFrame:
    """`fit_maps` of packed(key, order, ...) along `order` within a key: each fit starts from the one before (of the same
    shape), such as maps of neighbouring heading angles.  A key is one task's sequence, read map by map; results also have
    `order` and the number of mean steps."""
    ship(packed.sparkSession)
    keys = [*by, order]

    def run(batches: Iterable[pd.DataFrame]):
        last, state = None, None
        for batch in batches:
            for _, row in batch.iterrows():
                n, k = _maps(row)
                if last != (*(row[x] for x in by), n.shape):
                    last, state = (*(row[x] for x in by), n.shape), None
                spectrum, mean, (p, v, a) = _spectrum(n, k, row.get("period"), row.get("variance"), row.get("angle"), style)
                got = solver.fit(spectrum, n, k, mean, start=state)
                state = None if not warm else got.state()
                out = {x: [row[x]] for x in keys} | {"h": [n.shape[0]], "w": [n.shape[1]], "elbo": [got.elbo], "period": [p], "variance": [v], "angle": [a], "rounds": [got.rounds], "steps": [got.steps]}
                out |= {"rate": [got.rate().ravel()], "log_rate": [got.log_rate().ravel()], "log_var": [got.variance().ravel()]}
                yield pd.DataFrame(out)

    parts = max(1, int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = f"{_key(packed, keys)}, h int, w int, elbo double, period double, variance double, angle double, rounds int, steps int, rate array<double>, log_rate array<double>, log_var array<double>"
    return packed.repartition(parts, *by).sortWithinPartitions(*keys).mapInPandas(run, schema)


def prepare(points: DataFrame, size: int = 128, margin: float = 0.15, weight=None, by: list[str] = BY) -> DataFrame:
    """From samples (key, x, y, s) in metres to one packed row a key: arena (x0, x1, y0, y1, h, w, res), visits n, counts k,
    rate histogram y, heuristic period, variance and angle, and arrays kde (rate), prior_mean and kde_log (log rate of the
    map above the prior mean).  Arenas have `size` bins a side: the short side's are those of the square box."""
    from tessera.operators import binning, geometry, grids

    arena = geometry.arena(points, size, margin, by)
    edge = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    box = arena.select(*by, ((F.col("x0") + F.col("x1") - edge) / 2).alias("_x"), ((F.col("y0") + F.col("y1") - edge) / 2).alias("_y"), edge.alias("_e"))
    unit = points.join(box, by).withColumn("x", (F.col("x") - F.col("_x")) / F.col("_e")).withColumn("y", (F.col("y") - F.col("_y")) / F.col("_e"))
    grid = binning.visits_and_counts(unit, size, weight, by)
    packed = grids.pack(binning.rates(grid), size, size, ["n", "k", "y"], by).join(box.select(*by, F.col("_x").alias("x0"), F.col("_y").alias("y0"), F.col("_e").alias("edge")), by)

    def one(row: pd.Series) -> pd.DataFrame:
        n, k = _maps(row)
        p, v, a, mean = solver.heuristics(n, k)
        near = numerics.kde(n, k, p / (np.pi * np.sqrt(2)))
        out = {x: [row[x]] for x in [*by, "h", "w", "x0", "y0", "edge", "n", "k", "y"]} | {"period": [p], "variance": [v], "angle": [a]}
        out |= {"kde": [near.ravel()], "prior_mean": [mean.ravel()], "kde_log": [(np.log(np.maximum(near, 1e-10)) - mean).ravel()]}
        return pd.DataFrame(out)

    array = "array<double>"
    schema = f"{_key(packed, by)}, h int, w int, x0 double, y0 double, edge double, n {array}, k {array}, y {array}, period double, variance double, angle double, kde {array}, prior_mean {array}, kde_log {array}"
    return _run(packed, one, schema, by)


def regress(packed: DataFrame, fs: float, style: str = "radial", by: list[str] = BY) -> DataFrame:
    """Fits with their moments by bin (long form): key, iy, ix, log_rate, log_var, mean_rate, variance, cv, mean_hz,
    variance_hz, and the fit's elbo, period and prior variance."""
    from tessera.functions.safe import lognormal
    from tessera.operators import grids

    fitted = fit_maps(packed, style, by)
    long = grids.unpack(fitted, ["log_rate", "log_var"], by)
    moments = [c.alias(n) for n, c in lognormal(F.col("log_rate"), F.col("log_var"), fs).items()]
    scores = fitted.select(*by, "elbo", "period", F.col("variance").alias("prior_variance"))
    return long.select(*by, "iy", "ix", "log_rate", "log_var", *moments).join(scores, by)


def posterior_samples(packed: DataFrame, count: int, seed: int = 0, style: str = "radial", by: list[str] = BY) -> DataFrame:
    """Rows (key, sample_id, h, w, z) of the log rate less the prior mean; draws depend on seed, key and sample only."""
    from tessera.operators import lowrank

    drawn = lowrank.draws(lowrank.posterior(packed, style, by), count, seed, by)
    return drawn.select(*by, "sample_id", F.col("shape")[0].alias("h"), F.col("shape")[1].alias("w"), "z")


def laplace_peaks(packed: DataFrame, style: str = "radial", by: list[str] = BY) -> DataFrame:
    """Local maxima of the fitted log rate with the Laplace covariance of their place (in bins)."""

    def one(row: pd.Series) -> pd.DataFrame:
        n, k = _maps(row)
        spectrum, mean, _ = _spectrum(n, k, row.get("period"), row.get("variance"), row.get("angle"), style)
        got = solver.fit(spectrum, n, k, mean)
        z = got.log_rate()
        inner = z[1:-1, 1:-1]
        around = np.stack([z[1 + i : z.shape[0] - 1 + i, 1 + j : z.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
        found = np.argwhere(inner > around.max(axis=0)) + 1
        rows = [[row[x] for x in by] + [int(i), int(j), float(z[i, j]), *solver.peak_covariance(got, i, j)] for i, j in found]
        return pd.DataFrame(rows, columns=[*by, "iy", "ix", "log_rate", "xx", "xy", "yy"])

    return _run(packed, one, f"{_key(packed, by)}, iy int, ix int, log_rate double, xx double, xy double, yy double", by)


def linear_maps(packed: DataFrame, sigma: float, by: list[str] = BY) -> DataFrame:
    """Linear Gaussian-process rate (conjugate gradients) and its closed-form filter per key."""

    def one(row: pd.Series) -> pd.DataFrame:
        n, k = _maps(row)
        scale = max(float(np.var(k[n > 0] / n[n > 0])) if (n > 0).any() else 1.0, 1e-9)
        g = numerics.gaussian(*n.shape, sigma) * scale
        return pd.DataFrame({x: [row[x]] for x in by} | {"h": [n.shape[0]], "w": [n.shape[1]], "rate": [numerics.linear_gp(n, k, g).ravel()], "filtered": [numerics.wiener_gp(n, k, g).ravel()]})

    return _run(packed, one, f"{_key(packed, by)}, h int, w int, rate array<double>, filtered array<double>", by)


def _joint(row: pd.Series, style: str, keep: int) -> solver.Fit:
    shape = (int(row["d"]), int(row["h"]), int(row["w"]))
    n, k = np.asarray(row["n"], dtype=float).reshape(shape), np.asarray(row["k"], dtype=float).reshape(shape)
    p, v, a, mean = solver.heuristics(n.sum(axis=0), k.sum(axis=0))
    p, v, a = (float(row[c]) if c in row and row[c] is not None and np.isfinite(row[c]) else x for c, x in (("period", p), ("variance", v), ("angle", a)))
    space = kernels.spectrum(shape[1:], p, v, a, style, least=-np.inf)
    return solver.fit(kernels.joint_spectrum(shape[0], space, keep), n, k, np.broadcast_to(mean, shape))


def fit_headings(packed: DataFrame, angles: int, style: str = "radial", by: list[str] = BY, keep: int = 1000) -> DataFrame:
    """One joint heading x space fit per key of packed(key, d, h, w, n, k[, period, variance, angle]) with `angles` = d
    layers, on the `keep` largest frequencies: elbo and, per layer, its angle and rate array."""

    def one(row: pd.Series) -> pd.DataFrame:
        got, d = _joint(row, style, keep), int(row["d"])
        return pd.DataFrame({x: [row[x]] * d for x in by} | {"layer": range(d), "angle": np.arange(d) * 2 * np.pi / d, "elbo": got.elbo, "rate": [x.ravel() for x in got.rate()]})

    return _run(packed, one, f"{_key(packed, by)}, layer int, angle double, elbo double, rate array<double>", by)


def heading_samples(packed: DataFrame, count: int, seed: int = 0, style: str = "radial", by: list[str] = BY, keep: int = 1000) -> DataFrame:
    """Posterior draws of the joint fit: rows (key, layer, sample_id, h, w, z) of the log rate less the prior mean, for
    peaks and densities per heading."""
    from tessera.operators import lowrank

    drawn = lowrank.draws(lowrank.heading_posterior(packed, style, by, keep), count, seed, by)
    bins = F.col("shape")[1] * F.col("shape")[2]
    layers = F.transform(F.sequence(F.lit(0), F.col("shape")[0] - 1), lambda i: F.struct(i.alias("layer"), F.slice("z", i * bins + 1, bins).alias("z")))
    return drawn.select(*by, "sample_id", F.col("shape")[1].alias("h"), F.col("shape")[2].alias("w"), F.inline(layers)).select(*by, "layer", "sample_id", "h", "w", "z")


def heuristics(packed: DataFrame, by: list[str] = BY) -> DataFrame:
    """Period (bins), prior variance and orientation per key, from the autocorrelation of a kernel-density map."""

    def one(row: pd.Series) -> pd.DataFrame:
        p, v, a, _ = solver.heuristics(*_maps(row))
        return pd.DataFrame({x: [row[x]] for x in by} | {"period": [p], "variance": [v], "angle": [a]})

    return _run(packed, one, f"{_key(packed, by)}, period double, variance double, angle double", by)


def kde_maps(packed: DataFrame, sigma: float, by: list[str] = BY) -> DataFrame:
    """`grids.kde` on packed maps by FFT: for grids whose long form would multiply by their side length."""

    def one(row: pd.Series) -> pd.DataFrame:
        n, k = _maps(row)
        return pd.DataFrame({x: [row[x]] for x in by} | {"h": [n.shape[0]], "w": [n.shape[1]], "rate": [numerics.kde(n, k, sigma).ravel()]})

    return _run(packed, one, f"{_key(packed, by)}, h int, w int, rate array<double>", by)


def blurred_maps(packed: DataFrame, values: list[str], sigma: float | list[list[float]], unit: bool = False, by: list[str] = BY) -> DataFrame:
    """Packed values blurred circularly by a Gaussian: sigma is a deviation in bins or a 2 x 2 covariance of (x, y), where
    directions without variance are blurred throughout (its pseudo-inverse counts); peak one, or of unit sum."""

    def one(row: pd.Series) -> pd.DataFrame:
        shape = (int(row["h"]), int(row["w"]))
        kernel = numerics.gaussian(*shape, np.asarray(sigma) if np.ndim(sigma) else sigma)
        kernel = kernel / kernel.sum() if unit else kernel
        soft = {v: [numerics.convolve(np.asarray(row[v], dtype=float).reshape(shape), kernel).ravel()] for v in values}
        return pd.DataFrame({x: [row[x]] for x in by} | {"h": [shape[0]], "w": [shape[1]]} | soft)

    arrays = ", ".join(f"{v} array<double>" for v in values)
    return _run(packed, one, f"{_key(packed, by)}, h int, w int, {arrays}", by)


def upsampled(packed: DataFrame, value: str, factor: int, by: list[str] = BY) -> DataFrame:
    """Packed maps interpolated to `factor` times the bins a side by their band-limited spectrum."""

    def one(row: pd.Series) -> pd.DataFrame:
        h, w = int(row["h"]), int(row["w"])
        wide = numerics.upsample_2d(np.asarray(row[value], dtype=float).reshape(h, w), factor)
        return pd.DataFrame({x: [row[x]] for x in by} | {"h": [h * factor], "w": [w * factor], value: [wide.ravel()]})

    return _run(packed, one, f"{_key(packed, by)}, h int, w int, {value} array<double>", by)


def radial_profiles(packed: DataFrame, sigma: float = 2.0, by: list[str] = BY) -> DataFrame:
    """(key, r, value): radial average of the autocorrelation of a kernel-density map, on visited bins."""

    def one(row: pd.Series) -> pd.DataFrame:
        n, k = _maps(row)
        profile = numerics.radial_profile(numerics.autocorrelation(numerics.kde(n, k, sigma), n > 0))
        return pd.DataFrame({x: [row[x]] * len(profile) for x in by} | {"r": range(len(profile)), "value": profile})

    return _run(packed, one, f"{_key(packed, by)}, r int, value double", by)
