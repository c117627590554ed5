"""The solver's transforms, shared frequencies, stores, warm starts and posterior tables against plain versions."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels, solver
from tessera.operators import fits, lowrank, neighbors, series
from tessera.sources import recordings


def toy(seed=0, size=16, period=6.0, height=1.0):
    r = np.random.default_rng(seed)
    y, x = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    wave = sum(np.cos((x * np.cos(a) + y * np.sin(a)) * 2 * np.pi / period) for a in (0, np.pi / 3, 2 * np.pi / 3))
    n = r.poisson(30, (size, size)) * (r.random((size, size)) < 0.9) * 1.0
    return n, r.poisson(n * np.exp(height * wave) * 0.05).astype(float)


def packed(spark, seeds=(0, 1), size=16, **kw):
    rows = [(s, size, size, *(x.ravel().tolist() for x in toy(s, size, **kw))) for s in seeds]
    return spark.createDataFrame(rows, "cell_id long, h int, w int, n array<double>, k array<double>")


def dense_fit(spectrum, n, k, mean, rounds=10, steps=10, tol=1e-5):
    """The same alternation with the R x bins basis laid out, by plain matrix products."""
    kept, seen = spectrum > 0, n > 0
    at = np.argwhere(kept) / np.array(kept.shape)
    phase = at @ np.argwhere(np.ones(n.shape, bool)).T * (2 * np.pi)
    whole = (np.cos(phase) - np.sin(phase)) / np.sqrt(kept.size)
    f, prior = whole[:, seen.ravel()], spectrum[kept]
    u, v, visits, counts = np.zeros(len(prior)), np.zeros(seen.sum()), n[seen], k[seen]
    rate = lambda u, v: visits * np.exp(np.clip(u @ f + mean + v / 2, -10, 10))
    loss = lambda u, v: (rate(u, v) - counts * (u @ f + mean)).sum() + 0.5 * (u * u / prior).sum()
    for _ in range(rounds):
        old = u, v
        for _ in range(steps):
            lam = rate(u, v)
            step = np.linalg.solve((f * lam) @ f.T + np.diag(1 / prior), u / prior + f @ (lam - counts))
            size = 1.0
            while size > 1e-4 and loss(u - size * step, v) > loss(u, v):
                size /= 2
            u = u - size * step
            if np.abs(size * step).max() < tol:
                break
        cov = np.linalg.inv((f * rate(u, v)) @ f.T + np.diag(1 / prior))
        v = np.einsum("rm,rs,sm->m", f, cov, f)
        if max(np.abs(u - old[0]).max(), np.abs(v - old[1]).max()) < tol:
            break
    elbo = -(loss(u, v) + 0.5 * (np.log(prior).sum() - len(u) + (np.diag(cov) / prior).sum() - np.linalg.slogdet(cov)[1]))
    return elbo, u @ whole, np.einsum("rm,rs,sm->m", whole, cov, whole)


@pytest.mark.parametrize("method", ["direct", "krylov"])
@pytest.mark.parametrize("shape", [(16, 16), (12, 15)])
def test_fit_equals_the_dense_one(method, shape):
    n, k = (x[: shape[0], : shape[1]] for x in toy(3))
    s = kernels.spectrum(shape, 6.0, 0.7)
    got, (elbo, z, v) = solver.fit(s, n, k, -2.5, method=method), dense_fit(s, n, k, -2.5)
    assert abs(got.elbo - elbo) < 1e-6 and np.abs(got.log_rate().ravel() + 2.5 - z).max() < 1e-6 and np.abs(got.variance().ravel() - v).max() < 1e-6
    assert np.allclose(got.variance()[n > 0], got.v, atol=1e-4)


def test_waves_equal_the_basis():
    r = np.random.default_rng(0)
    for shape in ((8, 6), (3, 6, 5)):
        kept = r.random(shape) < 0.4
        w, f = solver.Waves(kept), solver.basis(kept)
        x, u = r.random(shape), r.random(kept.sum())
        assert np.allclose(w.field(u).ravel(), u @ f) and np.allclose(w.weights(x), f @ x.ravel())
        assert np.allclose(w.gram(x), (f * x.ravel()) @ f.T)
        c = r.random((len(u), len(u)))
        assert np.allclose(w.variance(c).ravel(), np.einsum("rm,rs,sm->m", f, c, f))
        assert np.allclose(w.field(np.stack([u, 2 * u]))[1].ravel(), 2 * u @ f)


def test_memory_of_a_large_fit():
    import tracemalloc

    n, k = toy(1, 128, 8.0)
    s = kernels.spectrum(n.shape, 8.0, 1.0)
    assert 900 < (s > 0).sum() <= 1000
    tracemalloc.start()
    got = solver.fit(s, n, k, -2.5, rounds=3)
    got.variance()
    assert tracemalloc.get_traced_memory()[1] < 50e6 and np.isfinite(got.elbo)
    tracemalloc.stop()
    with pytest.raises(ValueError, match="more than 1000"):
        solver.fit(kernels.spectrum(n.shape, 6.2, 1.0), n, k)


def test_updates_may_be_ones_own():
    """A gradient step as mean update and a damped variance reach the same bound."""
    n, k = toy(2)
    s = kernels.spectrum(n.shape, 6.0, 0.7)

    def slow(problem):
        newton = problem.newton("direct")
        return lambda u, v: 0.5 * newton(u, v)

    a = solver.fit(s, n, k, -2.5, tol=1e-9, rounds=60)
    b = solver.fit(s, n, k, -2.5, tol=1e-9, rounds=60, steps=40, mean_update=slow, damping=0.7)
    assert abs(a.elbo - b.elbo) < 1e-6 and b.steps > a.steps
    c = solver.fit(s, n, k, -2.5, variance_update=lambda problem: lambda u, v: np.zeros_like(v))
    assert np.abs(c.v).max() == 0


def test_warm_starts_take_fewer_steps(spark):
    n, k = toy(4, height=0.8)
    first = solver.fit(kernels.spectrum(n.shape, 6.0, 0.7), n, k, -2.5)
    s = kernels.spectrum(n.shape, 6.3, 0.75)
    cold, warm = solver.fit(s, n, k, -2.5), solver.fit(s, n, k, -2.5, start=first.state())
    assert warm.steps < cold.steps and abs(warm.elbo - cold.elbo) < 1e-6
    maps = packed(spark, (0, 5), height=0.8)
    args = ([4.0, 5.0, 6.0, 7.0, 8.0], [0.1, 0.3, 1.0, 3.0])
    a, b = ({r.cell_id: r for r in fits.climb(maps, *args, warm=w).collect()} for w in (True, False))
    assert all((a[i].period, a[i].variance, a[i].fits) == (b[i].period, b[i].variance, b[i].fits) and abs(a[i].elbo - b[i].elbo) < 1e-6 and a[i].steps < b[i].steps for i in b)
    grid = spark.createDataFrame([(i, 5.0 + i / 4, 0.5, 0.0) for i in range(8)], "param_id long, period double, variance double, angle double")
    a, b = ({(r.cell_id, r.param_id): r.elbo for r in fits.sweep(maps, grid, warm=w).collect()} for w in (True, False))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-6 for i in a)


def test_series_of_fits(spark):
    rows = [(c, layer, 16, 16, *(x.ravel().tolist() for x in toy(10 * c, 16, 6.0 + layer / 20, 0.8))) for c in (0, 1) for layer in range(5)]
    maps = spark.createDataFrame(rows, "cell_id long, layer int, h int, w int, n array<double>, k array<double>").repartition(3)
    warm, cold = ({(r.cell_id, r.layer): r for r in fits.fit_series(maps, "layer", warm=w).collect()} for w in (True, False))
    alone = {(r.cell_id, r.layer): r for r in fits.fit_maps(maps, by=["cell_id", "layer"]).collect()}
    assert alone.keys() == warm.keys() and all(abs(warm[i].elbo - alone[i].elbo) < 1e-5 and cold[i].elbo == alone[i].elbo for i in alone)
    assert sum(r.steps for r in warm.values()) < sum(r.steps for r in cold.values())


def test_shared_frequencies(spark):
    settings = [(3.0 + i / 10, 0.5, 0.0) for i in range(40)]
    grid = spark.createDataFrame([(k, *x) for k, x in enumerate(settings)], "param_id long, period double, variance double, angle double").repartition(7)
    got = fits.shared_frequencies(grid, [(16, 16), (12, 20)], "radial")
    for shape, kept in got.items():
        assert (kept == np.any([kernels.spectrum(shape, *x) > 0 for x in settings], axis=0)).all()
    with pytest.raises(ValueError, match="more than 1000"):
        fits.shared_frequencies(grid, [(64, 64)], "radial")
    with pytest.raises(ValueError, match="kept"):
        fits.sweep(packed(spark), grid.withColumn("angle", F.lit(None).cast("double")))


def plain_stages(n, k, ratio_p, ratio_v, np_, nv, na):
    """Three stages on one set of frequencies, by full loops instead of climbs."""
    p, v, _, mean = solver.heuristics(n, k)
    ps, vs = np.exp(np.linspace(np.log(p / ratio_p), np.log(p * ratio_p), np_)), np.exp(np.linspace(np.log(v / ratio_v), np.log(v * ratio_v), nv))
    kept = np.any([kernels.spectrum(n.shape, x, v) > 0 for x in ps] + [kernels.spectrum(n.shape, p, x) > 0 for x in vs], axis=0)
    score = lambda p, v, a, style: solver.fit(np.where(kept, np.maximum(kernels.spectrum(n.shape, p, v, a, style, kept=kept), 1e-9), 0), n, k, mean).elbo
    _, p, v = max((score(p, v, 0.0, "radial"), p, v) for p in ps for v in vs)
    _, a = max((score(p, v, a, "grid"), -a) for a in np.arange(na) * np.pi / 3 / na)
    best, p, v = max((score(p, v, -a, "grid"), p, v) for p in ps for v in vs)
    return best, p, v, -a, int(kept.sum())


def test_three_stages(spark, tmp_path):
    maps = packed(spark, (0, 6), height=0.6)
    small = lambda rows: fits.hyperparameters(rows, 1.3, 4.0, 5, 3, 4)
    want = {s: plain_stages(*toy(s, height=0.6), 1.3, 4.0, 5, 3, 4) for s in (0, 6)}
    store = f"{tmp_path}/fits"
    assert recordings.resume(maps.where("cell_id = 0"), store, small).count() == 1
    got = {r.cell_id: r for r in recordings.resume(maps, store, small).collect()}
    for s, (elbo, p, v, a, count) in want.items():
        r = got[s]
        assert abs(r.elbo - elbo) < 1e-4 and (r.frequencies, r.error) == (count, None) and np.allclose([r.period, r.variance, r.angle], [p, v, a])
    asked = []
    recordings.resume(maps, store, lambda rows: asked.append(1) or small(rows))
    assert not asked
    for _ in range(2):  # a job that runs again changes nothing, and puts new rows in place of old ones
        recordings.save(small(maps.where("cell_id = 6")), store)
    assert sorted(map(repr, recordings.load(spark, store).collect())) == sorted(map(repr, got.values()))
    recordings.save(recordings.load(spark, store).where("cell_id = 6").withColumn("elbo", F.lit(1.0)), store)
    assert {r.cell_id: r.elbo for r in recordings.load(spark, store).collect()} == {0: got[0].elbo, 6: 1.0}


def test_too_many_frequencies_are_told(spark):
    maps = packed(spark, (0,)).unionByName(packed(spark, (9,), 64, period=4.0).withColumn("cell_id", F.lit(9).cast("long")))
    got = {r.cell_id: r for r in fits.hyperparameters(maps, 4.0, 2.0, 25, 2, 2).collect()}
    assert got[0].error is None and got[0].elbo is not None
    assert got[9].elbo is None and "more than" in got[9].error


def test_moments_at_points(spark):
    """Mean, variance and covariance of posterior tables against the fits, at bins and between them, in any split."""
    maps = packed(spark)
    rows = lowrank.posterior(maps)
    places = [(c, f"p{k}", [k * 0.7, 15 - k * 0.9], [3.0, 4.5]) for c in (0, 1, 7) for k in range(12)]
    points = spark.createDataFrame(places, "cell_id long, point_id string, at array<double>, to array<double>").repartition(3)
    got = {(r.cell_id, r.point_id): r for r in lowrank.moments_at(rows, points).collect()}
    assert len(got) == 24
    for s in (0, 1):
        n, k = toy(s)
        p, v, _, mean = solver.heuristics(n, k)
        fit = solver.fit(kernels.spectrum(n.shape, p, v), n, k, mean)
        cov = fit.factor.T @ fit.factor
        freq = np.argwhere(fit.kept)
        freq = np.where(freq >= 8, freq - 16, freq) / 16
        wave = lambda at, freq=freq: (np.cos(2 * np.pi * freq @ np.array(at)) - np.sin(2 * np.pi * freq @ np.array(at))) / 16
        for c, name, at, to in places:
            if c == s:
                r, a, b = got[c, name], wave(at), wave(to)
                assert np.allclose([r.mean, r.variance, r.covariance], [fit.u @ a, a @ cov @ a, a @ cov @ b], atol=1e-9)
        i = np.argwhere(np.ones((16, 16)))[::17]
        exact = spark.createDataFrame([(s, j, [float(y), float(x)]) for j, (y, x) in enumerate(i)], "cell_id long, point_id int, at array<double>")
        for r in lowrank.moments_at(rows, exact, spread=1).collect():
            y, x = i[r.point_id]
            assert abs(r.mean - (fit.log_rate() - mean)[y, x]) < 1e-9 and abs(r.variance - fit.variance()[y, x]) < 1e-9
    again = {(r.cell_id, r.point_id): r for r in lowrank.moments_at(rows, points, spread=5).collect()}
    assert again.keys() == got.keys() and all(np.allclose(again[i][2:], got[i][2:], atol=1e-12) for i in got)


def test_draws_do_not_depend_on_the_split(spark):
    rows = lowrank.posterior(packed(spark))
    a, b = ({(r.cell_id, r.sample_id): r.z for r in lowrank.draws(rows, 50, 3, block=x).collect()} for x in (50, 7))
    assert a.keys() == b.keys() and len(a) == 100 and all(np.allclose(a[i], b[i], atol=1e-12) for i in a)
    other = {(r.cell_id, r.sample_id): r.z for r in lowrank.draws(rows, 5, 4).collect()}
    assert not any(np.allclose(a[i], other[i]) for i in other) and not np.allclose(a[0, 0], a[1, 0])


def test_bootstrap_weights(spark):
    got = series.bootstrap_weights(spark, 300, 12, 5).collect()
    by = Counter()
    for r in got:
        by[r.sample_id] += r.weight
    assert set(by.values()) == {13.0} and len(by) == 300
    taken = Counter()
    for r in got:
        taken[r.block_id] += r.weight
    assert set(taken) == set(range(12)) and all(abs(x - 325) < 5 * math.sqrt(325) for x in taken.values())
    assert series.bootstrap_weights(spark, 300, 12, 5).exceptAll(series.bootstrap_weights(spark, 300, 12, 5)).isEmpty()


def test_bootstrap_maps_equal_resampled_samples(spark):
    r = np.random.default_rng(2)
    rows = [(int(r.integers(0, 2)), int(t // 10), *map(float, r.random(2)), float(r.integers(0, 2))) for t in range(80)]
    points = spark.createDataFrame(rows, "cell_id long, block_id long, x double, y double, s double")
    from tessera.operators import binning

    weights = series.bootstrap_weights(spark, 6, 8, 1)
    got = series.bootstrap_maps(binning.visits_and_counts(points, 4, by=["cell_id", "block_id"]), weights, ["n", "k"])
    copies = points.join(weights, "block_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))))
    want = {(x.cell_id, x.sample_id, x.iy, x.ix): (x.n, x.k) for x in binning.visits_and_counts(copies, 4, by=["cell_id", "sample_id"]).collect()}
    assert {(x.cell_id, x.sample_id, x.iy, x.ix) for x in got.collect()} == set(want)
    assert all(np.allclose((x.n, x.k), want[x.cell_id, x.sample_id, x.iy, x.ix]) for x in got.collect())


@pytest.mark.parametrize("by", [["g"], []])
def test_alias_flags_keep_every_point(spark, by):
    """A point without a place, or of a key without others, is not aliased, whatever the number of others."""
    r = np.random.default_rng(3)
    rows = [(int(k % 2), k, *map(float, r.random(2))) for k in range(40)] + [(0, 90, None, 0.5), (5, 91, 0.5, 0.5), (1, 92, None, None)]
    points = spark.createDataFrame(rows, "g int, id long, x double, y double")
    others = spark.createDataFrame([(int(k % 2), k, *map(float, r.random(2))) for k in range(30)], "g int, o long, x double, y double")
    found = [{r.id: r.aliased for r in neighbors.alias_flags(points, others, "o", by, 1.4, small=s).collect()} for s in (1000, 5)]
    assert found[0] == found[1] and len(found[0]) == 43 and not found[0][90] and not found[0][92] and any(found[0].values())


@pytest.mark.parametrize("small", [4096, 10])
def test_mutual_nearest_equals_all_pairs(spark, small, monkeypatch):
    monkeypatch.setattr(neighbors.nearest, "__defaults__", ([], None, small))
    r = np.random.default_rng(7)
    make = lambda n: spark.createDataFrame([(int(k % 3), k, *(float(x) for x in np.round(r.random(2), 1))) for k in range(n)], "g int, id long, x double, y double")
    left, right = make(40), make(55).where("g < 2")
    want = neighbors.mutual(neighbors.candidate_pairs(left, right, ["g"]), ["g"])
    got = neighbors.mutual_nearest(left, right, ["g"])
    assert sorted((x.g, x.src, x.dst, round(x.dist, 9)) for x in got.collect()) == sorted((x.g, x.src, x.dst, round(x.dist, 9)) for x in want.collect())
