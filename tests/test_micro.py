"""Hand-computed cases and numerics of the library's operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalogue
from tessera.functions import kernels, numerics, safe, savgol, solver
from tessera.operators import binning, fits, geometry, grids, moments, neighbors, series
from tessera.sources import recordings, simulate
from tessera.streaming.rates import windowed_counts


def one(spark, values, column="x"):
    return spark.createDataFrame([(0, k, v) for k, v in enumerate(values)], f"cell_id long, t long, {column} double")


def column(df, name):
    return [r[name] for r in df.orderBy("t").collect()]


@pytest.mark.parametrize("mode, want", [("compat", [0, 0, 1.5, 3]), ("linear", [0, 1, 2, 3])])
def test_gaps(spark, mode, want):
    assert column(series.fill_gaps(one(spark, [0.0, None, None, 3.0]), ["x"], mode=mode), "x") == want


def test_gap_ends(spark):
    values = [None, None, 4.0, 6.0, None]
    assert column(series.fill_gaps(one(spark, values), ["x"]), "x") == [6.0, 6.0, 6.0, 6.0, 6.0]
    assert column(series.fill_gaps(one(spark, values), ["x"], mode="linear"), "x") == [4.0, 4.0, 4.0, 6.0, 6.0]
    assert column(series.fill_gaps(one(spark, [None, None]), ["x"]), "x") == [None, None]


@pytest.mark.parametrize("pad, want", [(True, [(1, 3), (4, 5)]), (False, [(1, 3)])])
def test_runs(spark, pad, want):
    got = series.run_edges(one(spark, [0.0, 1.0, 1.0, 0.0, 1.0]), F.col("x") == 1, pad=pad)
    assert sorted((r.start, r.stop) for r in got.collect()) == want


def mass(spark, p, size, **kinds):
    df = spark.createDataFrame([(0, p, 1.0)], "cell_id long, x double, s double")
    got = binning.bin_linear(df, [binning.Axis("x", size, "ix", **kinds)], {"n": F.lit(1.0)})
    out = [0.0] * size
    for r in got.collect():
        out[r.ix] = r.n
    return out


def test_linear_shares(spark):
    assert mass(spark, 0.25, 3) == [0.5, 0.5, 0]
    assert mass(spark, 1.0, 3) == [0, 0, 1]
    assert mass(spark, 0.875, 4, wrap=True) == [0.5, 0, 0, 0.5]
    assert mass(spark, 1.0, 4, wrap=True) == [1, 0, 0, 0]
    for p in (-0.1, 1.1):
        with pytest.raises(Exception, match="outside the unit interval"):
            mass(spark, p, 3)


def test_mass_is_kept(spark):
    r = np.random.default_rng(0)
    df = spark.createDataFrame([(0, float(a), float(b), 1.0, float(w)) for a, b, w in r.random((300, 3))], "cell_id long, x double, y double, s double, w double")
    got = binning.visits_and_counts(df, 9, F.col("w")).agg(F.sum("n"), F.sum("k")).first()
    want = df.agg(F.sum("w")).first()[0]
    assert abs(got[0] - want) < 1e-9 and abs(got[1] - want) < 1e-9


def test_safe_division(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0), (-2.0, 0.0), (6.0, 3.0)], "a double, b double")
    assert [r[0] for r in df.select(safe.sdiv(F.col("a"), F.col("b"))).collect()] == [0.0, 2.0**64, -(2.0**64), 2.0]


def test_spike_counts(spark):
    got = binning.spike_counts(spark.createDataFrame([(0, 0.25), (0, 2.5), (0, 7.0)], "cell_id long, t_sec double"), 1.0, 3)
    assert column(got, "count") == [0.75, 0.25, 1.0]


def test_kde_of_a_constant_rate(spark):
    cells = [(0, i, j, float(1 + (i * j) % 5), 0.3 * (1 + (i * j) % 5)) for i in range(6) for j in range(5)]
    got = grids.kde(spark.createDataFrame(cells, "cell_id long, iy int, ix int, n double, k double"), 6, 5, 1.3)
    assert all(abs(r.rate - 0.3) < 1e-12 for r in got.collect()) and got.count() == 30


def test_blur_equals_fft(spark):
    r = np.random.default_rng(1)
    a = r.random((6, 8))
    df = spark.createDataFrame([(0, i, j, float(a[i, j])) for i in range(6) for j in range(8)], "cell_id long, iy int, ix int, n double")
    want = numerics.convolve(a, numerics.gaussian(6, 8, 1.7))
    assert all(abs(x.n - want[x.iy, x.ix]) < 1e-9 for x in grids.blur(df, ["n"], 6, 8, 1.7).collect())


def field(spark, a):
    h, w = a.shape
    return spark.createDataFrame([(0, i, j, float(a[i, j])) for i in range(h) for j in range(w)], "cell_id long, iy int, ix int, z double")


def test_peak_refinement_is_exact(spark):
    y, x = np.meshgrid(np.arange(9), np.arange(9), indexing="ij")
    got = grids.interpolate_peaks(field(spark, 10 - (x - 4.3) ** 2 - (y - 3.8) ** 2), "z", 9, 9).collect()
    assert len(got) == 1 and abs(got[0].x - 4.8 / 9) < 1e-9 and abs(got[0].y - 4.3 / 9) < 1e-9 and abs(got[0].height - 10) < 1e-9


def test_negative_borders_have_no_peaks(spark):
    a = -np.ones((5, 5))
    a[0, 2], a[2, 2] = -0.5, -0.2
    assert [(r.iy, r.ix) for r in grids.find_peaks(field(spark, a), "z", 5, 5).collect()] == [(2, 2)]


def test_transforms_against_fft(spark):
    a = np.random.default_rng(2).random((4, 6))
    t = np.fft.fft2(a)
    want = (t.real + t.imag) / np.sqrt(24)
    assert all(abs(x.c - want[x.ky, x.kx]) < 1e-9 for x in grids.hartley(field(spark, a), "z", 4, 6).collect())
    ac = numerics.autocorrelation(a, np.ones_like(a, dtype=bool))
    assert all(abs(x.ac - ac[x.iy, x.ix]) < 1e-9 for x in grids.autocorrelation(field(spark, a), "z", 4, 6).collect())


def test_radial_delta(spark):
    a = np.zeros((5, 5))
    a[2, 2] = 1
    assert {r.r: r.z for r in grids.radial_average(field(spark, a), "z", 5, 5).collect()} == {0: 1.0, 1: 0.0, 2: 0.0, 3: 0.0}


def test_pack_round_trip(spark):
    a = np.random.default_rng(3).random((3, 4))
    packed = grids.pack(field(spark, a), 3, 4, ["z"])
    assert np.allclose(packed.first().z, a.ravel())
    assert grids.unpack(packed, ["z"]).exceptAll(field(spark, a)).count() == 0


def test_savitzky_golay(spark):
    assert savgol.order(50, 2, 50) == 11
    t = np.arange(40.0)
    line = one(spark, (3 + 2 * t).tolist())
    assert np.allclose(column(series.smooth(line, "x", "v", 4, 3), "v")[4:-4], (3 + 2 * t)[4:-4])
    assert np.allclose(column(series.differentiate(line, "x", "v", 4, 3, 50.0), "v"), 100.0)
    square = one(spark, (t**2).tolist())
    assert np.allclose(column(series.differentiate(square, "x", "v", 6, 5, 1.0, 2), "v")[10:-10], 2.0)


def test_heading(spark):
    t = np.arange(30.0)
    df = spark.createDataFrame([(0, int(k), float(k), float(-k)) for k in t], "cell_id long, t long, x double, y double")
    assert np.allclose(column(series.heading_angle(df, 3, 2, 50.0), "heading"), -math.pi / 4)


def test_folds_cover_once(spark):
    got = series.cross_validation(one(spark, [1.0] * 23), 5)
    assert got.where("is_test").count() == 23 and got.count() == 115


def test_resampling(spark):
    draws = series.random_draws(spark, 2, 4, seed=1)
    assert draws.count() == 10 and draws.collect() == series.random_draws(spark, 2, 4, seed=1).collect()
    whole = series.random_draws(spark, 1, 4, replace=False)
    got = series.resample_blocks(one(spark, [float(k) for k in range(12)]), whole, 3)
    assert sorted(r.x for r in got.collect()) == list(range(12)) and sorted(r.pos_t for r in got.collect()) == list(range(12))


def test_hull_and_distance(spark):
    r = np.random.default_rng(4)
    p = r.random((200, 2))
    h = numerics.convex_hull(p)
    area = 0.5 * abs((h[:, 0] * np.roll(h[:, 1], -1) - np.roll(h[:, 0], -1) * h[:, 1]).sum())
    assert 0.7 < area < 1
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in p], "cell_id long, x double, y double").repartition(7)
    edges = geometry.hull(df)
    assert edges.count() == len(h)
    planes = geometry.half_planes(edges)
    assert df.join(planes, "cell_id").where(~geometry.in_hull(F.col("x"), F.col("y"), F.col("planes"))).count() == 0
    assert numerics.convex_hull(np.array([[0.0, 0], [1, 1], [2, 2]])).shape[0] == 2


def test_dilation(spark):
    df = spark.createDataFrame([(0, 0, 0)], "cell_id long, iy int, ix int")
    assert {(r.iy, r.ix) for r in geometry.dilate(df, 1.0, 5, 5).collect()} == {(0, 0), (0, 1), (1, 0)}


def test_ellipse():
    assert abs(geometry.ellipse_radius(0.95) - 2.4477) < 1e-4 and abs(geometry.ellipse_radius(0.95, "1D") - 1.96) < 1e-3


def test_matching_equals_greedy(spark):
    r = np.random.default_rng(5)
    a, b = r.random((12, 2)), r.random((9, 2))
    left = spark.createDataFrame([(0, k, float(x), float(y)) for k, (x, y) in enumerate(a)], "g int, id long, x double, y double")
    right = spark.createDataFrame([(0, k, float(x), float(y)) for k, (x, y) in enumerate(b)], "g int, id long, x double, y double")
    d = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
    want, rows, cols = set(), set(range(12)), set(range(9))
    while rows and cols:
        new = [(i, j) for i in rows for j in cols if d[i, j] == min(d[i, k] for k in cols) and d[i, j] == min(d[k, j] for k in rows)]
        want |= set(new)
        rows, cols = rows - {i for i, _ in new}, cols - {j for _, j in new}
    got = {(x.src, x.dst) for x in neighbors.match(left, right, ["g"], 0.3).collect()}
    assert got == {(i, j) for i, j in want if d[i, j] <= 0.3}
    assert got == {(x.src, x.dst) for x in neighbors.match(left, right, ["g"], 0.3, small=5).collect()}


def test_components_and_chains(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 6), (8, 7), (7, 6)], "a long, b long")
    assert {r.node: r.label for r in neighbors.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, 7: 5, 8: 5}
    steps = spark.createDataFrame([(k, 0, 0) for k in range(4)] + [(1, 1, 1)], "layer long, src long, dst long")
    got = neighbors.chains(steps, 4, 3).collect()
    assert {(r.layer, r.id) for r in got} == {(k, 0) for k in range(4)} and [r.pos for r in sorted(got, key=lambda r: r.layer)] == [0, 1, 2, 3]
    wide = neighbors.cardinal_points(neighbors.chains(steps, 4, 3), {"north": 0, "south": 2}).collect()
    assert [(r.north, r.south) for r in wide] == [(0, 0)]
    peaks = spark.createDataFrame([(k, 0, 0.1 * k, 0.0) for k in range(4)], "layer long, id long, x double, y double")
    assert [(r.origin, r.opposite) for r in neighbors.opposite(steps, 4, 0, 1.0, peaks).collect()] == [(0, 0)]


def test_scores(spark):
    rows = [(0, 10.0, 2.0, 0.2), (0, 5.0, 4.0, 0.8)]
    got = moments.deviance_scores(spark.createDataFrame(rows, "cell_id long, n double, k double, rate double"), ["cell_id"]).first()
    assert abs(got.explained - 1) < 1e-12 and got.delta > 0


def test_bessel():
    assert np.abs(numerics.j0(np.array(numerics.J0_ZEROS))).max() < 1e-12 and abs(float(numerics.j0(np.array(0.0))) - 1) < 1e-15


@pytest.mark.parametrize("style", ["radial", "grid", "band", "square", "rbf"])
@pytest.mark.parametrize("window", ["square", "parzen", "triangle", "gaussian"])
def test_kernels(style, window):
    k = kernels.grid_kernel(6.0, (24, 20), style, 0.3, window=window)
    assert np.allclose(k, np.roll(k[::-1, ::-1], (1, 1), (0, 1))) and abs(k.max() - k[0, 0]) < 1e-9 and k[0, 0] >= 1 - 1e-4
    assert np.fft.fft2(k).real.min() > 0
    with pytest.raises(ValueError):
        kernels.grid_kernel(1.5, (8, 8))


def toy(seed=0, size=16, period=6.0):
    r = np.random.default_rng(seed)
    y, x = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    wave = sum(np.cos((x * np.cos(a) + y * np.sin(a)) * 2 * np.pi / period) for a in (0, np.pi / 3, 2 * np.pi / 3))
    rate = np.exp(0.5 * wave) * 0.05
    n = r.poisson(30, (size, size)).astype(float)
    return rate, n, r.poisson(n * rate).astype(float)


def test_solver_gradient_and_bound():
    _, n, k = toy()
    s = kernels.spectrum(n.shape, 6.0, 0.5)
    got = solver.fit(s, n, k, math.log(0.05))
    f = solver.basis(s > 0, n > 0)
    lam = n[n > 0] * solver.sexp(got.u @ f + math.log(0.05) + 0.5 * got.v)
    assert np.abs(got.u / s[s > 0] + f @ (lam - k[n > 0])).max() < 1e-2
    assert got.trace[-1] >= got.trace[0] - 1e-6
    full = solver.basis(np.ones((4, 4), bool))
    assert np.allclose(full @ full.T, np.eye(16))
    cov = got.factor.T @ got.factor
    precision = (f * lam) @ f.T + np.diag(1 / s[s > 0])
    assert np.allclose(cov @ precision, np.eye(len(cov)), atol=1e-2)


def test_solver_equals_dense_gaussian_process():
    """With all frequencies kept, the mean solves the dense problem on the grid."""
    r = np.random.default_rng(3)
    n = r.integers(0, 6, (6, 6)).astype(float)
    k = r.poisson(n * 0.3).astype(float)
    s = np.fft.fft2(numerics.gaussian(6, 6, 1.2) * 0.5 + 0.05 * (np.arange(36).reshape(6, 6) == 0)).real
    got = solver.fit(s, n, k, -1.0, rounds=1, steps=50)
    z = np.zeros(36)
    d = np.arange(36)
    cov = np.fft.ifft2(s).real[(d[:, None] // 6 - d // 6) % 6, (d[:, None] % 6 - d % 6) % 6]
    for _ in range(60):
        lam = n.ravel() * np.exp(z - 1)
        z = z - np.linalg.solve(np.eye(36) + cov * lam, z - cov @ (k.ravel() - lam))
    assert np.abs(got.log_rate().ravel() + 1 - z).max() < 1e-6


def test_recovery_beats_smoothing():
    rate, n, k = toy(1, 32, 8.0)
    p, v, a, mean = solver.heuristics(n, k)
    assert abs(p - 8) / 8 < 0.15
    got = solver.fit(kernels.spectrum(n.shape, p, v, a, "grid"), n, k, mean).rate()
    best = max(np.corrcoef(numerics.kde(n, k, s).ravel(), rate.ravel())[0, 1] for s in (1.0, 1.5, 2.0, 3.0))
    assert np.corrcoef(got.ravel(), rate.ravel())[0, 1] > best - 0.02


def test_samples_and_climb():
    _, n, k = toy()
    got = solver.fit(kernels.spectrum(n.shape, 6.0, 0.5), n, k, math.log(0.05))
    draws = got.samples(3000, 1)
    assert np.abs(draws.var(axis=0) - got.variance()).max() < 0.2 * got.variance().max()
    at, seen = solver.hill_climb((9, 9), lambda i: -((i[0] - 7) ** 2) - (i[1] - 1) ** 2)
    assert at == (7, 1) and len(seen) < 40


def test_linear_gp_reduces_error():
    rate, n, k = toy(2)
    raw = k / np.maximum(n, 1)
    kernel = numerics.gaussian(16, 16, 1.5) * rate.var()
    assert ((numerics.linear_gp(n, k, kernel) - rate) ** 2).mean() < ((raw - rate) ** 2).mean()
    assert ((numerics.wiener_gp(n, k, kernel) - rate) ** 2).mean() < ((raw - rate) ** 2).mean()


def packed(spark, seeds=(0, 1)):
    rows = []
    for s in seeds:
        _, n, k = toy(s)
        rows.append((s, 16, 16, n.ravel().tolist(), k.ravel().tolist()))
    return spark.createDataFrame(rows, "cell_id long, h int, w int, n array<double>, k array<double>")


def test_fits_in_spark(spark):
    got = {r.cell_id: r for r in fits.fit_maps(packed(spark)).collect()}
    assert len(got) == 2 and all(len(r.rate) == 256 and min(r.rate) > 0 for r in got.values())
    found = fits.optimise(packed(spark, (0,)), [4.0, 6.0, 8.0], [0.1, 0.5], [0.0, 0.5]).first()
    assert found.period == 6.0


def test_simulated_recordings(spark):
    df = simulate.explorations(spark, 2, 20.0, 50.0, 0.4)
    assert df.count() == 2000 and df.agg(F.max("x")).first()[0] <= 1 and sorted(map(repr, df.collect())) == sorted(map(repr, simulate.explorations(spark, 2, 20.0, 50.0, 0.4).collect()))
    counted = simulate.counts(simulate.rate_map(spark, 12, 5.0), 20.0)
    assert counted.where("rate = 0 and n > 0").count() == 0


def test_recording_contract(spark, tmp_path):
    samples = spark.createDataFrame([(0, t, 100.0 + t, 50.0) for t in range(5)], "cell_id long, t long, x_px double, y_px double")
    spikes = spark.createDataFrame([(0, 3.0), (0, 4.0)], "cell_id long, spike_sample double")
    meta = spark.createDataFrame([(0, 50.0, 1000.0, 100.0)], "cell_id long, pos_rate double, px_per_m double, spk_rate double")
    got = recordings.track(samples, spikes, meta).orderBy("t").collect()
    assert [r.s for r in got] == [0, 0.5, 1.5, 0, 0] and abs(got[0].x - 0.1) < 1e-12
    with pytest.raises(ValueError, match="x_px"):
        recordings.track(samples.drop("x_px"), spikes, meta)
    store = f"{tmp_path}/fits"
    keys = spark.range(3).withColumnRenamed("id", "cell_id")
    assert recordings.pending(keys, spark, store, ["cell_id"]).count() == 3
    recordings.save(keys.where("cell_id < 2"), store)
    assert [r.cell_id for r in recordings.pending(keys, spark, store, ["cell_id"]).collect()] == [2]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m}0:00", 0, 0.1 * m, 0.2 * h, 1.0) for h in range(4) for m in range(5)]
    df = spark.createDataFrame(rows, "ts string, cell_id long, x double, y double, s double").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = windowed_counts(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 4)
    query = stream.writeStream.outputMode("complete").format("memory").queryName("rates_out").start()
    query.processAllAvailable()
    query.stop()
    rounded = lambda out: sorted((str(r.start), r.iy, r.ix, round(r.n, 9), round(r.k, 9)) for r in out.collect())
    assert rounded(spark.table("rates_out")) == rounded(windowed_counts(df, 4))


def scattered(spark, n, seed, keys=1, span=1.0):
    r = np.random.default_rng(seed)
    rows = [(int(k % keys), k, float(x), float(y)) for k, (x, y) in enumerate(r.random((n, 2)) * span)]
    return rows, spark.createDataFrame(rows, "g int, id long, x double, y double")


@pytest.mark.parametrize("radius", [None, 0.05])
@pytest.mark.parametrize("keys", [1, 3])
def test_bucketed_searches_equal_packed_ones(spark, radius, keys):
    by = ["g"] if keys > 1 else []
    rows, points = scattered(spark, 150, 1, keys, 1.3)
    rows += [(0, 900, 30.0, -4.0), (0, 901, rows[0][2], rows[0][3])]
    points = spark.createDataFrame(rows + [(7, 950, 0.5, 0.5), (0, 951, None, 0.5)], "g int, id long, x double, y double")
    _, others = scattered(spark, 90, 2, keys)
    others = others.select("g", F.col("id").alias("o"), "x", "y")
    found = [sorted(map(repr, neighbors.nearest(points, others, "o", by, radius, small=s).collect())) for s in (1000, 10)]
    assert found[0] == found[1]
    flags = [sorted(map(repr, neighbors.alias_flags(points.where("x is not null"), others, "o", by, 1.3, small=s).collect())) for s in (1000, 10)]
    assert flags[0] == flags[1]


def test_matching_has_no_limit_of_rounds(spark):
    """Points whose gaps shrink along a line match one pair a round."""
    at = np.cumsum(1 / np.arange(1, 141) ** 0.5)
    left = spark.createDataFrame([(0, k, float(at[2 * k]), 0.0) for k in range(70)], "g int, id long, x double, y double")
    right = spark.createDataFrame([(0, k, float(at[2 * k + 1]), 0.0) for k in range(70)], "g int, id long, x double, y double")
    assert neighbors.match(left, right, ["g"], 10.0).count() == 70
    assert {r.g for r in neighbors.match_rounds(left.where("id < 12"), right.where("id < 12"), ["g"], 10.0).collect()} == {0}
    assert neighbors.match_rounds(left.where("id < 12"), right.where("id < 12"), ["g"], 10.0).count() == 12


def test_recordings_keep_their_own_sample_time(spark):
    """A jump of 0.1 m is patched at 50 Hz and kept at 5 Hz; an event on the last edge counts whole."""
    rows = [(c, t, 100.0 * (t == 5), 0.0) for c in (0, 1) for t in range(10)]
    samples = spark.createDataFrame(rows, "cell_id long, t long, x_px double, y_px double")
    meta = spark.createDataFrame([(0, 50.0, 1000.0, 50.0), (1, 5.0, 1000.0, 5.0)], "cell_id long, pos_rate double, px_per_m double, spk_rate double")
    spikes = spark.createDataFrame([(0, 9.5)], "cell_id long, spike_sample double")
    with pytest.warns(UserWarning, match="1 recordings have no spikes"):
        got = recordings.track(samples, spikes, meta, warn=True).collect()
    assert max(r.x for r in got if r.cell_id == 0) < 0.1 - 1e-9 and max(r.x for r in got if r.cell_id == 1) == 0.1
    assert sum(r.s for r in got) == 1.0


def test_chains_run_along_the_path(spark):
    """A path over the cyclic border starts at its open end."""
    steps = spark.createDataFrame([(2, 4, 5), (3, 5, 6), (0, 6, 7)], "layer long, src long, dst long")
    got = {(r.layer, r.id): r.pos for r in neighbors.chains(steps, 4, 3).collect()}
    assert got == {(2, 4): 0, (3, 5): 1, (0, 6): 2, (1, 7): 3}


def test_kernel_waves_run_against_the_angle():
    """Offsets are turned by +angle, so band waves run along x cos - y sin."""
    k = kernels.grid_kernel(8.0, (32, 32), "band", 0.3, clip=False, blur=False)
    d = np.fft.fftfreq(32, 1 / 32)
    x, y = d[None, :], d[:, None]
    taper = np.outer(np.fft.ifftshift(np.hanning(32)), np.fft.ifftshift(np.hanning(32)))
    want = np.cos((x * np.cos(0.3) - y * np.sin(0.3)) * 2 * np.pi / 8) * taper
    want = np.fft.ifft2(np.maximum(np.fft.fft2(want / want.max()).real, 1e-9)).real
    assert np.abs(k - want).max() < 1e-12
    rate, n, _ = toy(0, 32, 8.0)
    assert abs((numerics.orientation(rate, n > 0, 8.0) + 0.26) % (np.pi / 3) - 0.26) < 0.05


def test_draws_follow_the_expected_maps(spark):
    maps = {(r.iy, r.ix): r for r in simulate.expected_maps(spark, 24, 8.0, mean=0.5).collect()}
    rows = catalogue.QUERIES["simulated_counts"](spark, "").collect()
    want = [(maps[r.iy, r.ix].visits * 20, maps[r.iy, r.ix].background) for r in rows]
    assert abs(sum(r.n for r in rows) - sum(v for v, _ in want)) < 5 * math.sqrt(sum(v for v, _ in want))
    expected = sum(r.n * b for r, (_, b) in zip(rows, want))
    assert abs(sum(r.k for r in rows) - expected) < 5 * math.sqrt(expected) and all(r.k == 0 for r in rows if r.rate == 0)


def test_explorations_follow_their_map(spark):
    """Steps of the path are small, and events are as many as the map gives along it."""
    rows = simulate.explorations(spark, 1, 200.0, 50.0, 0.2, size=32).orderBy("t").collect()
    xy = np.array([(r.x, r.y) for r in rows])
    assert np.abs(np.diff(xy, axis=0)).max() <= 2 / 32 + 1e-12 and xy.min() >= 4 / 32 and xy.max() <= 28 / 32
    rates = simulate.background_map(32, 6.4)
    at = np.rint(xy * 32).astype(int)
    expected = rates[at[:, 1], at[:, 0]].sum() / 50
    assert abs(sum(r.s for r in rows) - expected) < 5 * math.sqrt(expected)


@pytest.mark.parametrize("by", [["g"], []])
def test_quantiles_equal_numpy(spark, by):
    r = np.random.default_rng(4)
    rows = [(int(g), float(v)) for g, v in zip(r.choice([0, 0, 0, 1, 2], 3000), np.round(r.normal(size=3000), 2))] + [(5, 7.0), (0, None)]
    got = moments.quantiles(spark.createDataFrame(rows, "g int, v double").repartition(5), "v", [0.0, 0.05, 0.5, 0.77, 1.0], by).collect()
    for x in got:
        own = [v for g, v in rows if v is not None and (not by or g == x.g)]
        assert x.n == len(own) and np.allclose(x.q, np.quantile(own, [0.0, 0.05, 0.5, 0.77, 1.0]), atol=1e-12)
    assert len(got) == (4 if by else 1)


def test_fits_may_start_anywhere(spark):
    base = packed(spark, (0,))
    cold = fits.fit_maps(base).first()
    warm = fits.fit_maps(base.withColumn("start", F.array_repeat(F.lit(0.7), 256))).first()
    assert abs(cold.elbo - warm.elbo) < 1e-3 and np.abs(np.array(cold.log_rate) - np.array(warm.log_rate)).max() < 1e-2
    again = fits.fit_maps(base.withColumn("start", F.lit([float(x) for x in np.array(cold.log_rate) - solver.heuristics(*(np.array(getattr(base.first(), c)).reshape(16, 16) for c in "nk"))[3].ravel()]))).first()
    assert again.rounds <= cold.rounds


def test_dither_parts_a_plateau(spark):
    rows = [(0, i, j, 1.0 if (i, j) in ((4, 4), (4, 5), (5, 4), (5, 5)) else 0.0) for i in range(9) for j in range(9)]
    field = spark.createDataFrame(rows, "cell_id int, iy int, ix int, v double")
    assert grids.interpolate_peaks(field, "v", 9, 9, 1.5).count() == 0
    got = grids.interpolate_peaks(field, "v", 9, 9, 1.5, dither=1e-9).collect()
    assert len([r for r in got if r.iy in (4, 5) and r.ix in (4, 5)]) == 1


def test_shuffles_keep_all(spark):
    keys = spark.range(40).withColumnRenamed("id", "cell_id")
    a, b, c = ([r.cell_id for r in recordings.shuffled(keys.repartition(k), ["cell_id"], seed).collect()] for k, seed in ((1, 0), (3, 0), (2, 1)))
    assert a == b and a != c and sorted(a) == sorted(c) == list(range(40)) and a != sorted(a)
