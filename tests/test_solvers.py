"""Fits and posterior queries against dense versions: covariances between bins instead of frequencies, loops instead of joins."""

from __future__ import annotations

import math
from pathlib import Path

import numpy as np
import pytest

from tessera import catalogue
from tessera.functions import kernels, numerics, solver
from tessera.operators import fits
from tessera.plans import queries as q

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


def covariance(spectrum: np.ndarray) -> np.ndarray:
    """Between all bins of a periodic grid, from its spectrum."""
    c = np.fft.ifftn(spectrum).real
    at = np.indices(spectrum.shape).reshape(spectrum.ndim, -1)
    return c[tuple((at[d][:, None] - at[d][None, :]) % s for d, s in enumerate(spectrum.shape))]


class Dense:
    """The variational fixed point in bins: mean z and covariance of the log rate less the prior mean."""

    def __init__(self, spectrum: np.ndarray, n: np.ndarray, k: np.ndarray, mean) -> None:
        self.whole = covariance(np.where(spectrum > 0, np.maximum(spectrum, 1e-12), 0))
        seen = np.flatnonzero(n.ravel() > 0)
        s, visits, counts = self.whole[np.ix_(seen, seen)], n.ravel()[seen], k.ravel()[seen]
        z0 = np.broadcast_to(mean, n.shape).ravel()[seen]
        z, v = np.zeros(len(seen)), np.zeros(len(seen))
        for _ in range(15):
            for _ in range(40):
                lam = visits * solver.sexp(z + z0 + v / 2)
                new = np.linalg.solve(np.eye(len(z)) + s * lam, s @ (counts - lam + lam * z))
                step = new - z
                z = z + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
                if np.abs(step).max() < 1e-7:
                    break
            lam = visits * solver.sexp(z + z0 + v / 2)
            old, inner = v, np.linalg.solve(s + np.diag(1 / lam), s)
            v = np.diag(s - s @ inner)
            if np.abs(v - old).max() < 1e-6:
                break
        cross = self.whole[:, seen]
        self.shape, self.mean = n.shape, np.broadcast_to(mean, n.shape).ravel()
        self.z = cross @ (counts - lam)
        self.cov = self.whole - cross @ np.linalg.solve(s + np.diag(1 / lam), cross.T)
        self.log_rate, self.log_var = self.mean + self.z, np.diag(self.cov)
        rank, root = (spectrum > 0).sum(), np.sqrt(lam)
        _, logdet = np.linalg.slogdet(np.eye(len(z)) + root[:, None] * s * root)
        trace = rank - np.trace(np.linalg.solve(s + np.diag(1 / lam), s))
        lam = visits * solver.sexp(z + z0 + v / 2)
        self.elbo = -((lam - counts * (z + z0)).sum() + 0.5 * (logdet - rank + z @ (counts - lam) + trace))

    def rate(self) -> np.ndarray:
        return solver.sexp(self.log_rate + self.log_var / 2)


@pytest.fixture(scope="module")
def maps(spark):
    rows = q._packed(spark, FOLDER).collect()
    return {r.cell_id: (np.array(r.n).reshape(16, 16), np.array(r.k).reshape(16, 16)) for r in rows}


@pytest.fixture(scope="module")
def dense(maps):
    out = {}
    for key, (n, k) in maps.items():
        p, v, a, mean = solver.heuristics(n, k)
        out[key] = Dense(kernels.spectrum(n.shape, p, v, a), n, k, mean)
    return out


def run(spark, name):
    return catalogue.QUERIES[name](spark, FOLDER).collect()


def test_fit_map(spark, dense):
    got = run(spark, "lgcp_fit_map")
    assert len(got) == len(dense) > 0
    for r in got:
        want = dense[r.cell_id]
        assert abs(r.elbo - want.elbo) < 1e-3 * max(1, abs(want.elbo))
        assert np.abs(np.array(r.log_rate) - want.log_rate).max() < 2e-3 and np.abs(np.array(r.log_var) - want.log_var).max() < 2e-3
        assert np.allclose(r.rate, want.rate(), rtol=5e-3)


def test_regressed_maps(spark, maps):
    got = run(spark, "regressed_maps")
    by = {}
    for r in got:
        by.setdefault(r.cell_id, []).append(r)
    for r in q._packed(spark, FOLDER, 12).collect():
        n, k = (np.array(x).reshape(12, 12) for x in (r.n, r.k))
        p, v, a, mean = solver.heuristics(n, k)
        want = Dense(kernels.spectrum(n.shape, p, v, a), n, k, mean)
        assert len(by[r.cell_id]) == 144
        for x in by[r.cell_id]:
            mu, var = want.log_rate[x.iy * 12 + x.ix], want.log_var[x.iy * 12 + x.ix]
            assert abs(x.log_rate - mu) < 2e-3 and abs(x.log_var - var) < 2e-3
            assert abs(x.mean_hz - 50 * math.exp(mu + var / 2)) < 1e-2 * x.mean_hz + 1e-4 and abs(x.cv - math.sqrt(math.expm1(var))) < 1e-2 * x.cv + 1e-3


def swept(n, k, settings, style="radial"):
    kept = np.zeros(n.shape, bool)
    for p, v, a in settings:
        kept |= kernels.spectrum(n.shape, p, v, a, style) > 0
    _, _, _, mean = solver.heuristics(n, k)
    return [Dense(np.where(kept, np.maximum(kernels.spectrum(n.shape, p, v, a, style, kept=kept), 1e-9), 0), n, k, mean).elbo for p, v, a in settings]


def test_sweep_and_profiles(spark, maps):
    settings = [(2.0 * (i // 3) + 4, 10.0 ** (i % 3 - 2), 0.0) for i in range(9)]
    want = {(key, i): e for key, (n, k) in maps.items() for i, e in enumerate(swept(n, k, settings))}
    got = run(spark, "lgcp_elbo_sweep")
    assert {(r.cell_id, r.param_id): (r.period, r.variance) for r in got} == {(c, i): settings[i][:2] for c, i in want}
    assert all(abs(r.elbo - want[r.cell_id, r.param_id]) < 1e-3 * max(1, abs(r.elbo)) for r in got)
    best = {}
    for (c, i), e in want.items():
        best[c, settings[i][1]] = max(best.get((c, settings[i][1]), -np.inf), e)
    for r in run(spark, "elbo_profiles"):
        top = max(e for (c, _), e in best.items() if c == r.cell_id)
        assert abs(r.elbo - best[r.cell_id, r.variance]) < 1e-3 * abs(r.elbo) and abs(r.below_best - (top - best[r.cell_id, r.variance])) < 1e-2


def test_hill_climb(spark, maps):
    periods, variances = [4.0, 5.0, 6.0, 7.0, 8.0], [0.01, 0.03, 0.1, 0.3]
    for r in run(spark, "lgcp_hill_climb"):
        n, k = maps[r.cell_id]
        _, _, _, mean = solver.heuristics(n, k)
        score = lambda i, j, n=n, k=k, mean=mean: Dense(kernels.spectrum(n.shape, periods[i], variances[j], 0.0), n, k, mean).elbo
        i, j = periods.index(r.period), variances.index(r.variance)
        assert abs(r.elbo - score(i, j)) < 1e-3 * abs(r.elbo)
        around = [(i + a, j + b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)) if 0 <= i + a < 5 and 0 <= j + b < 4]
        assert all(score(*at) <= r.elbo + 1e-3 * abs(r.elbo) for at in around) and len(around) < r.fits <= 20


def test_climb_order():
    """On a line the climb goes on in its direction, and visits no point twice."""
    asked = []
    best, seen = solver.hill_climb((9,), lambda at: asked.append(at) or -abs(at[0] - 7))
    assert best == (7,) and len(asked) == len(set(asked)) == len(seen) and asked[0] == (4,)


def test_posterior_samples(spark, maps):
    rows = run(spark, "lgcp_posterior_samples")
    assert len(rows) == 8 * len(maps) and all(len(r.z) == 256 for r in rows)
    small = q._packed(spark, FOLDER, 8)
    draws = {}
    for r in fits.posterior_samples(small, 4000, 5).collect():
        draws.setdefault(r.cell_id, []).append(r.z)
    for r in small.collect():
        n, k = (np.array(x).reshape(8, 8) for x in (r.n, r.k))
        p, v, a, mean = solver.heuristics(n, k)
        want, z = Dense(kernels.spectrum(n.shape, p, v, a), n, k, mean), np.array(draws[r.cell_id])
        spread = np.sqrt(want.log_var)
        assert np.abs((z.mean(axis=0) - want.z) / np.maximum(spread, 1e-6)).max() < 0.1
        assert np.abs(np.cov(z.T) - want.cov).max() < 0.12 * want.log_var.max()


def gradients(want: Dense, i: int, j: int, surface: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(2 x bins stencil of the gradient, Hessian of the surface) at a bin."""
    h, w = want.shape
    cell = lambda a, b: (i + a) % h * w + (j + b) % w
    g = np.zeros((2, h * w))
    g[0, cell(0, 1)], g[0, cell(0, -1)], g[1, cell(1, 0)], g[1, cell(-1, 0)] = 0.5, -0.5, 0.5, -0.5
    at = lambda a, b: surface[cell(a, b)]
    xy = (at(1, 1) + at(-1, -1) - at(1, -1) - at(-1, 1)) / 4
    return g, np.array([[at(0, 1) - 2 * at(0, 0) + at(0, -1), xy], [xy, at(1, 0) - 2 * at(0, 0) + at(-1, 0)]])


def test_laplace_confidence(spark, dense):
    got = run(spark, "laplace_confidence")
    assert got
    for r in got:
        want = dense[r.cell_id]
        g, h = gradients(want, r.iy, r.ix, want.log_rate)
        s = np.linalg.pinv(h) @ (g @ want.cov @ g.T) @ np.linalg.pinv(h).T
        assert np.allclose([r.xx, r.xy, r.yy], [s[0, 0], s[0, 1], s[1, 1]], rtol=0.03, atol=0.02 * np.abs(s).max())
        z = want.log_rate.reshape(16, 16)
        assert z[r.iy, r.ix] > max(z[r.iy + a, r.ix + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b) - 4e-3


@pytest.mark.parametrize(("name", "rate"), [("laplace_joint", False), ("laplace_joint_rate", True)])
def test_laplace_joint(spark, dense, name, rate):
    rows = run(spark, name)
    spots = {(r.cell_id, r.a): (r.iy, r.ix) for r in rows}
    assert rows
    for r in rows:
        want = dense[r.cell_id]
        surface, half = (want.rate() if rate else want.log_rate), []
        for who in (r.a, r.b):
            i, j = spots[r.cell_id, who]
            g, h = gradients(want, i, j, surface)
            at = i * 16 + j
            half.append(np.linalg.pinv(-h) @ (g * (want.rate()[at] * math.exp(want.log_var[at] / 2) if rate else 1.0)))
        s = half[0] @ want.cov @ half[1].T + (1e-5 * np.eye(2) if r.a == r.b else 0)
        scale = np.abs(half[0] @ want.cov @ half[0].T).max() ** 0.5 * np.abs(half[1] @ want.cov @ half[1].T).max() ** 0.5
        assert np.allclose([[r.xx, r.xy], [r.yx, r.yy]], s, rtol=0.05, atol=0.04 * scale)


def test_linear_gp(spark, maps):
    for r in run(spark, "linear_gp"):
        n, k = maps[r.cell_id]
        seen = np.flatnonzero(n.ravel() > 0)
        visits, y, mean = n.ravel()[seen], k.ravel()[seen] / n.ravel()[seen], k.sum() / n.sum()
        g = numerics.gaussian(16, 16, 2.0) * max(np.var(y), 1e-9)
        cov = covariance(np.fft.fft2(g).real)
        want = mean + cov[:, seen] @ np.linalg.solve(cov[np.ix_(seen, seen)] + np.diag(mean / visits), y - mean)
        assert np.abs(np.array(r.rate) - want).max() < 1e-5
        gain = np.fft.fft2(g).real * n.mean() / mean
        field = np.zeros(256)
        field[seen] = y - mean
        smooth = np.fft.ifft2(np.fft.fft2(field.reshape(16, 16)) * gain / (gain + 1)).real
        assert np.abs(np.array(r.filtered) - mean - smooth.ravel()).max() < 1e-9


def joint(spark, size, layers):
    for r in q._joint_packed(spark, FOLDER, layers, size).collect():
        n, k = (np.array(x).reshape(layers, size, size) for x in (r.n, r.k))
        p, v, a, mean = solver.heuristics(n.sum(axis=0), k.sum(axis=0))
        spectrum = kernels.joint_spectrum(layers, kernels.spectrum((size, size), p, v, a, least=-np.inf), 1000)
        yield r.cell_id, Dense(spectrum, n, k, np.broadcast_to(mean, n.shape))


def test_heading_fit(spark):
    got = {(r.cell_id, r.layer): r for r in run(spark, "lgcp_heading_fit")}
    for key, want in joint(spark, 12, 6):
        rate = want.rate().reshape(6, 144)
        for layer in range(6):
            r = got.pop((key, layer))
            assert abs(r.elbo - want.elbo) < 2e-3 * abs(want.elbo) and abs(r.angle - layer * math.pi / 3) < 1e-12
            assert np.allclose(r.rate, rate[layer], rtol=0.02, atol=1e-4)
    assert not got


def test_heading_samples_and_density(spark):
    packed = q._joint_packed(spark, FOLDER, 4, 8)
    rows = fits.heading_samples(packed, 1500, 3).collect()
    for key, want in joint(spark, 8, 4):
        z = np.zeros((1500, 4, 64))
        for r in rows:
            if r.cell_id == key:
                z[r.sample_id, r.layer] = r.z
        z = z.reshape(1500, -1)
        assert np.abs((z.mean(axis=0) - want.z) / np.maximum(np.sqrt(want.log_var), 1e-6)).max() < 0.15
        assert np.abs(z.var(axis=0) - want.log_var).max() < 0.2 * want.log_var.max()
    density = run(spark, "heading_density")
    assert density and all(0 < r.n <= 8 for r in density) and {r.layer for r in density} <= set(range(4))


def test_heading_variance(spark):
    from tessera.operators import grids, tracking

    points = q.fixtures.points(spark, FOLDER).withColumn("a", q.F.col("h") * (2 * math.pi))
    packed = grids.pack(tracking.heading_maps(points, "a", 4, 12), 12, 12, ["n", "k"], ["cell_id", "layer"]).collect()
    got = {(r.cell_id, r.layer): r for r in run(spark, "heading_variance")}
    assert len(got) == len(packed)
    for r in packed:
        n, k = (np.array(x).reshape(12, 12) for x in (r.n, r.k))
        e = swept(n, k, [(5.0, 0.05 * f, 0.0) for f in (0.3, 1.0, 3.0)], "grid")
        x = got[r.cell_id, r.layer]
        at = [0.3, 1.0, 3.0].index(min((0.3, 1.0, 3.0), key=lambda f: abs(f - x.factor)))
        assert e[at] > max(e) - 1e-3 * abs(max(e)) and abs(x.elbo - e[at]) < 1e-3 * abs(x.elbo)


def plain_peaks(z: np.ndarray, radius: float, quantile: float) -> list[tuple[float, float, float]]:
    """(x, y, height) of refined local maxima of a square map, highest first."""
    size, r, out = len(z), max(1.0, radius), []
    low = np.quantile(z, quantile)
    for i in range(size):
        for j in range(size):
            near = [(i + a, j + b) for a in range(-int(r), int(r) + 1) for b in range(-int(r), int(r) + 1) if 0 < a * a + b * b <= r * r]
            top = max(z[a, b] if 0 <= a < size and 0 <= b < size else 0.0 for a, b in near)
            if not (z[i, j] > top and z[i, j] > low):
                continue
            p = lambda a, b, i=i, j=j: z[min(max(i + a, 0), size - 1), min(max(j + b, 0), size - 1)]
            g = np.array([(p(0, 1) - p(0, -1)) / 2, (p(1, 0) - p(-1, 0)) / 2])
            xy = (p(1, 1) - p(1, -1) - p(-1, 1) + p(-1, -1)) / 4
            h = np.array([[p(0, 1) - 2 * p(0, 0) + p(0, -1), xy], [xy, p(1, 0) - 2 * p(0, 0) + p(-1, 0)]])
            if abs(np.linalg.det(h)) < 2.0**-63:
                continue
            o = np.linalg.solve(h, g)
            x, y = (j - o[0] + 0.5) / size, (i - o[1] + 0.5) / size
            if 0 <= x <= 1 - 1 / size and 0 <= y <= 1 - 1 / size:
                out.append((x, y, p(0, 0) - g @ o / 2))
    return sorted(out, key=lambda t: -t[2])


def test_heading_peaks(spark):
    from tessera.operators import grids, tracking

    points = q.fixtures.points(spark, FOLDER).withColumn("a", q.F.col("h") * (2 * math.pi))
    packed = grids.pack(tracking.heading_maps(points, "a", 4, 12), 12, 12, ["n", "k"], ["cell_id", "layer"])
    fitted = {(r.cell_id, r.layer): np.array(r.log_rate).reshape(12, 12) for r in fits.fit_maps(packed, by=["cell_id", "layer"]).collect()}
    got = {}
    for r in run(spark, "heading_peaks"):
        got.setdefault((r.cell_id, r.layer), []).append((r.id, r.x, r.y, r.height))
    for key, z in fitted.items():
        want = plain_peaks(z, 1.0, 0.25)
        assert np.allclose([x[1:] for x in sorted(got.get(key, []))], want, atol=1e-9) if want else key not in got
    for r in packed.collect()[:4]:
        n, k = (np.array(x).reshape(12, 12) for x in (r.n, r.k))
        p, v, a, mean = solver.heuristics(n, k)
        assert np.abs(Dense(kernels.spectrum(n.shape, p, v, a), n, k, mean).log_rate.reshape(12, 12) - fitted[r.cell_id, r.layer]).max() < 5e-3


def linear_density(points: list[tuple[float, float]], size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for x, y in points:
        u, v = x * (size - 1), y * (size - 1)
        a, b = min(int(u), size - 2), min(int(v), size - 2)
        for dy in (0, 1):
            for dx in (0, 1):
                out[b + dy, a + dx] += (v - b if dy else 1 - v + b) * (u - a if dx else 1 - u + a)
    return out


def test_sampled_confidence(spark):
    size, period = 16, 6.0
    samples = fits.posterior_samples(q._packed(spark, FOLDER), 24, 3).collect()
    got = {(r.cell_id, r.field): r for r in run(spark, "sampled_confidence")}
    keys = {r.cell_id for r in samples}
    for key in keys:
        maps_ = [np.array(r.z).reshape(size, size) for r in samples if r.cell_id == key]
        found = [(x, y) for z in maps_ for x, y, _ in plain_peaks(z, period / 2, 0.25)]
        density = linear_density(found, size) / 24
        soft = numerics.convolve(density, numerics.gaussian(size, size, max(0.5, period / 10)))
        fields = plain_peaks(soft, max(1.0, period / 4), 0.5)
        cells = {}
        for i, j in np.argwhere(density > 0):
            x, y = (j + 0.5) / size, (i + 0.5) / size
            d = [math.hypot(x - a, y - b) for a, b, _ in fields]
            if d and min(d) <= 0.7 * period / size:
                cells.setdefault(int(np.argmin(d)) + 1, []).append((density[i, j], x, y))
        for field, rows in cells.items():
            w, x, y = np.array(rows).T
            if w.sum() < 0.1:
                assert (key, field) not in got
                continue
            r, share = got.pop((key, field)), w / w.sum()
            mx, my = share @ x, share @ y
            want = [w.sum(), mx, my, share @ (x - mx) ** 2, share @ ((x - mx) * (y - my)), share @ (y - my) ** 2]
            assert np.allclose([r.total, r.mx, r.my, r.xx, r.xy, r.yy], want, atol=1e-6)
    assert not got


def test_prior_draws(spark):
    size, rows = 16, run(spark, "prior_draws")
    spectrum = np.fft.fft2(kernels.grid_kernel(6.0, (size, size), "grid", 0.0)).real * 0.5
    at = np.indices((size, size)).reshape(2, -1)
    wave = np.exp(-2j * np.pi * (np.outer(at[0], at[0]) + np.outer(at[1], at[1])) / size)
    for r in rows:
        noise = np.random.default_rng(int(r.sample_id)).standard_normal((size, size)).ravel()
        want = (wave.conj() @ (wave @ noise * np.sqrt(np.maximum(spectrum, 0)).ravel())).real / size**2
        assert np.abs(np.array(r.z) - want).max() < 1e-9


def test_heading_confidence(spark):
    rows = run(spark, "heading_confidence")
    assert all(r.total >= 0.01 and r.xx >= 0 and r.yy >= 0 and 0.02 < r.mx < 0.98 and 0.02 < r.my < 0.98 for r in rows)


def test_prepared_maps(spark):
    rows = run(spark, "prepared_maps")
    points = q.fixtures.points(spark, FOLDER).collect()
    for key in {r.cell_id for r in rows}:
        own = [(p.x * 1.5 - 0.2, p.y, p.s) for p in points if p.cell_id == key]
        x, y, s = map(np.array, zip(*own))
        pad = max(np.ptp(x), np.ptp(y)) * 0.3
        wide, tall = np.ptp(x) + pad, np.ptp(y) + pad
        w, h = (16, round(tall / wide * 16)) if wide >= tall else (round(wide / tall * 16), 16)
        edge = max(wide / w, tall / h) * 16
        u, v = (x - (x.max() + x.min()) / 2) / edge + 0.5, (y - (y.max() + y.min()) / 2) / edge + 0.5
        n = linear_density(list(zip(u, v)), 16)
        k = linear_density([(a, b) for a, b, c in zip(u, v, s) if c], 16)
        got = {(r.iy, r.ix): r for r in rows if r.cell_id == key}
        p, _, _, mean = solver.heuristics(n, k)
        near = numerics.kde(n, k, p / (math.pi * math.sqrt(2)))
        for (i, j), r in got.items():
            assert abs(r.n - n[i, j]) < 1e-5 and abs(r.k - k[i, j]) < 1e-5 and abs(r.kde - near[i, j]) < 1e-5
            assert abs(r.prior_mean - mean[i, j]) < 1e-4 and abs(r.kde_log - math.log(near[i, j]) + mean[i, j]) < 1e-4


def test_best_parameters(spark):
    """The third stage's best of all settings at the angle that the second found, on the first stage's frequencies."""
    packed = {r.cell_id: r for r in q._packed(spark, FOLDER, 12).collect()}
    kept = np.any([kernels.spectrum((12, 12), p, v) > 0 for p in (4.0, 6.0) for v in (0.01, 0.1)], axis=0)
    for r in run(spark, "best_parameters"):
        n, k = (np.array(x).reshape(12, 12) for x in (packed[r.cell_id].n, packed[r.cell_id].k))
        _, _, _, mean = solver.heuristics(n, k)
        scores = {(p, v): Dense(np.where(kept, np.maximum(kernels.spectrum(n.shape, p, v, r.angle, "grid", kept=kept), 1e-9), 0), n, k, mean).elbo for p in (4.0, 6.0) for v in (0.01, 0.1)}
        assert abs(r.elbo - scores[r.period, r.variance]) < 1e-3 * abs(r.elbo) and r.elbo > max(scores.values()) - 1e-3 * abs(r.elbo)


def test_heading_quadratic(spark):
    """Covariances and turns of peaks at each heading, and between neighbouring headings, from dense covariances of the joint fit."""
    from tessera.operators import posterior

    got = {}
    for r in posterior.heading_quadratic(q._joint_packed(spark, FOLDER)).collect():
        got.setdefault(r.cell_id, []).append(r)
    for key, want in joint(spark, 12, 6):
        z = want.log_rate.reshape(6, 12, 12)
        cell = lambda t, i, j: (t % 6) * 144 + (i % 12) * 12 + j % 12
        half = {}
        for r in got.get(key, []):
            t, i, j = r.layer, r.iy, r.ix
            g = np.zeros((2, z.size))
            g[0, cell(t, i, j + 1)], g[0, cell(t, i, j - 1)], g[1, cell(t, i + 1, j)], g[1, cell(t, i - 1, j)] = 0.5, -0.5, 0.5, -0.5
            at = lambda a, b, c, t=t, i=i, j=j: z[(t + a) % 6, (i + b) % 12, (j + c) % 12]
            xy = (at(0, 1, 1) + at(0, -1, -1) - at(0, 1, -1) - at(0, -1, 1)) / 4
            h = np.array([[at(0, 0, 1) - 2 * at(0, 0, 0) + at(0, 0, -1), xy], [xy, at(0, 1, 0) - 2 * at(0, 0, 0) + at(0, -1, 0)]])
            cross = np.array([(at(1, 0, 1) + at(-1, 0, -1) - at(1, 0, -1) - at(-1, 0, 1)) / 4, (at(1, 1, 0) + at(-1, -1, 0) - at(1, -1, 0) - at(-1, 1, 0)) / 4])
            half[t, r.peak] = np.linalg.pinv(-h) @ g
            s = half[t, r.peak] @ want.cov @ half[t, r.peak].T
            assert np.allclose([r.xx, r.xy, r.yy], [s[0, 0], s[0, 1], s[1, 1]], rtol=0.05, atol=0.03 * np.abs(s).max())
            turn = np.linalg.pinv(-h) @ cross
            assert np.allclose([r.x_turn, r.y_turn], turn, rtol=0.05, atol=0.03 * max(np.abs(turn).max(), 0.1))
        for r in got.get(key, []):
            for link in r.links:
                a, b = half[r.layer, r.peak], half[(r.layer + 1) % 6, link.peak]
                s = a @ want.cov @ b.T
                scale = np.sqrt(np.abs(a @ want.cov @ a.T).max() * np.abs(b @ want.cov @ b.T).max())
                assert np.allclose([[link.xx, link.xy], [link.yx, link.yy]], s, rtol=0.05, atol=0.04 * scale)
    assert any(got.values())


def test_sample_fields(spark):
    """Fields and members of draws against plain loops."""
    from tessera.operators import geometry, posterior

    size, period = 16, 6.0
    samples = fits.posterior_samples(q._packed(spark, FOLDER), 12, 3).cache()
    planes = geometry.half_planes(geometry.hull(q.fixtures.points(spark, FOLDER).select("cell_id", "x", "y")))
    fields, members = posterior.sample_fields(samples, size, period, planes, edge=0.05, height=0.25, least=0.3, localisation=0.15)
    fields, owned = {(r.cell_id, r.field): r for r in fields.collect()}, {}
    for r in members.collect():
        owned.setdefault((r.cell_id, r.field), []).append((r.sample_id, r.x, r.y))
    assert fields.keys() == owned.keys() and fields
    rows = samples.collect()
    radius = period / 2.5
    seen = set()
    for key in {r.cell_id for r in rows}:
        found = [(r.sample_id, x, y) for r in rows if r.cell_id == key for x, y, _ in plain_peaks(np.array(r.z).reshape(size, size), radius, 0.25)]
        density = linear_density([(x, y) for _, x, y in found], size) / 12
        places = plain_peaks(numerics.convolve(density, numerics.gaussian(size, size, max(radius / 7, 0.4))), radius, 0.0)
        groups = {}
        for s, x, y in found:
            d = [math.hypot(x - a, y - b) for a, b, _ in places]
            if d and min(d) <= period / size:
                groups.setdefault(int(np.argmin(d)) + 1, []).append((s, x, y))
        for field, rows_ in groups.items():
            s, x, y = map(np.array, zip(*rows_))
            cov = np.cov(x, y, bias=True)
            # the points fill the unit square, so the edge is a margin of it
            inside = min(x.mean(), 1 - x.mean(), y.mean(), 1 - y.mean())
            if abs(inside - 0.05) < 0.01:
                seen.add((key, field))
                continue
            kept = len(set(s)) / 12 >= 0.3 and np.sqrt(max(np.linalg.eigvalsh(cov).max(), 0)) <= 0.15 and inside > 0.05
            assert ((key, field) in fields) == kept
            if kept:
                seen.add((key, field))
                r = fields[key, field]
                assert np.allclose([r.total, r.probability, r.mx, r.my, r.xx, r.xy, r.yy], [len(rows_) / 12, len(set(s)) / 12, x.mean(), y.mean(), cov[0, 0], cov[0, 1], cov[1, 1]], atol=1e-6)
                assert np.allclose(sorted(rows_), sorted(owned[key, field]), atol=1e-6)
    assert set(fields) <= seen
