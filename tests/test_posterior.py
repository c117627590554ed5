"""Posterior and tracking operators on small cases."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import kernels, solver
from tessera.operators import fits, geometry, posterior, tracking


def packed(spark, size=16):
    r = np.random.default_rng(0)
    y, x = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    rate = 0.05 * np.exp(sum(np.cos((x * np.cos(a) + y * np.sin(a)) * 2 * np.pi / 6) for a in (0, np.pi / 3, 2 * np.pi / 3)) / 2)
    n = r.poisson(60, (size, size)).astype(float)
    k = r.poisson(n * rate).astype(float)
    return spark.createDataFrame([(0, size, size, n.ravel().tolist(), k.ravel().tolist())], "cell_id long, h int, w int, n array<double>, k array<double>")


def test_joint_blocks_on_the_diagonal_are_the_single_covariances(spark):
    single = {(r.iy, r.ix): (r.xx, r.xy, r.yy) for r in fits.laplace_peaks(packed(spark)).collect()}
    joint = posterior.joint_confidence(packed(spark), ridge=0.0).where("a = b").collect()
    assert single and {(r.iy, r.ix) for r in joint} == set(single)
    assert all(np.allclose((r.xx, r.xy, r.yy), single[r.iy, r.ix]) for r in joint)
    both = posterior.joint_confidence(packed(spark), ridge=0.0).collect()
    by = {(r.a, r.b): r for r in both}
    assert all(abs(r.xy - by[r.b, r.a].yx) < 1e-9 for r in both)


def test_sampled_fields_lie_at_the_rate_peaks(spark):
    fitted = fits.fit_maps(packed(spark)).first()
    rate = np.array(fitted.rate).reshape(16, 16)
    fields = posterior.sampled_confidence(fits.posterior_samples(packed(spark), 40, 1), 16, 6.0, least=0.3).collect()
    assert fields
    for f in fields:
        iy, ix = min(15, int(f.my * 16)), min(15, int(f.mx * 16))
        assert rate[max(0, iy - 1) : iy + 2, max(0, ix - 1) : ix + 2].max() > rate.mean()
        assert f.xx > 0 and f.yy > 0 and abs(f.xy) <= math.sqrt(f.xx * f.yy) + 1e-12


def test_fraction_inside(spark):
    square = spark.createDataFrame([(0, x, y) for x in (0.0, 1.0) for y in (0.0, 1.0)], "cell_id long, x double, y double")
    planes = geometry.half_planes(geometry.hull(square))
    g = spark.createDataFrame([(0, 1, 0.5, 0.5, 1e-4, 0.0, 1e-4), (0, 2, 0.0, 0.5, 1e-4, 0.0, 1e-4), (0, 3, None, 0.5, None, None, None)], "cell_id long, field long, mx double, my double, xx double, xy double, yy double")
    got = {r.field: r.fraction for r in posterior.fraction_inside(g, planes, 2000).collect()}
    assert got[1] == 1.0 and abs(got[2] - 0.5) < 0.05 and 3 not in got


def test_scalar_fit_is_stationary(spark):
    df = spark.createDataFrame([(0.5, 2.0, 3.0), (-1.0, 0.5, 0.0)], "m double, p double, y double")
    for r in posterior.scalar_fits(df, "m", "p", "y", 100).collect():
        lam = math.exp(r.mu + r.v / 2)
        assert abs(lam - r.y + r.p * (r.mu - r.m)) < 1e-9 and abs(r.v * (r.p + lam) - 1) < 1e-9


def test_zero_lag_of_a_parabola(spark):
    df = spark.createDataFrame([(0, k, 5.0 - 0.3 * k * k) for k in range(6)], "cell_id long, r int, y double")
    assert abs(posterior.zero_lag(df, "y").first().zero_lag - 5) < 1e-12


def test_profiles(spark):
    df = spark.createDataFrame([(0, 1.0, 0.1, -5.0), (0, 1.0, 0.2, -3.0), (0, 2.0, 0.1, -4.0)], "cell_id long, period double, variance double, elbo double")
    assert {r.period: (r.elbo, r.below_best) for r in posterior.profiles(df, "period").collect()} == {1.0: (-3.0, 0.0), 2.0: (-4.0, 1.0)}


def test_prior_draws_have_the_kernel_covariance(spark):
    draws = np.array([r.z for r in posterior.prior_draws(spark, 600, 8, 4.0, 0.5, style="radial").collect()])
    cov = draws.T @ draws / len(draws)
    want = kernels.grid_kernel(4.0, (8, 8), "radial") * 0.5
    assert np.abs(cov[0].reshape(8, 8) - want).max() < 0.12
    assert (posterior.prior_draws(spark, 2, 8, 4.0, 0.5).collect()) == posterior.prior_draws(spark, 2, 8, 4.0, 0.5).collect()


def test_links_are_trimmed_to_loops(spark):
    ring = [(k, 0, math.cos(k * math.pi / 4) * 0.1, math.sin(k * math.pi / 4) * 0.1) for k in range(8)]
    far = [(7, 1, 5.0, 5.0)]
    peaks = spark.createDataFrame(ring + far, "layer long, id long, x double, y double")
    chains = spark.createDataFrame([(1, k, 0) for k in range(8)] + [(1, 7, 1), (2, 0, 0), (2, 1, 0)], "chain_id long, layer long, id long")
    got = tracking.link_peaks(chains, peaks, 8, 0.1).collect()
    assert {r.chain_id for r in got} == {1} and (7, 1) not in {(r.layer, r.id) for r in got} and len(got) == 8
    middle = tracking.path_regions(tracking.link_peaks(chains, peaks, 8, 0.1), spark.createDataFrame([(0, 0.0, 0.0), (4, 9.0, 9.0)], "id long, x double, y double")).first()
    assert middle.region == 0 and not middle.shared


def test_matches_keep_id_zero(spark):
    a = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 1.0)], "id long, x double, y double")
    b = spark.createDataFrame([(0, 0.05, 0.0), (5, 9.0, 9.0)], "id long, x double, y double")
    assert [(r.tracked, r.sampled) for r in tracking.tracked_matches(a, b, 0.5).collect()] == [(0, 0)]


def test_displacement(spark):
    df = spark.createDataFrame([(3.0, 4.0, 1.0, 0.0, 1.0), (1.0, 1.0, 0.0, 0.0, 0.0)], "dx double, dy double, xx double, xy double, yy double")
    assert [r.displacement for r in tracking.displacement(df).collect()] == [5.0, None]


def test_heading_maps_split_the_weight(spark):
    df = spark.createDataFrame([(0, 0.5, 0.5, 1.0, 0.0), (0, 0.5, 0.5, 0.0, math.pi / 2)], "cell_id long, x double, y double, s double, a double")
    got = tracking.heading_maps(df, "a", 4, 3, 2).groupBy("layer").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).orderBy("layer").collect()
    assert [(r.layer, round(r.n, 9), round(r.k, 9)) for r in got if r.n > 1e-12] == [(0, 1.0, 1.0), (1, 1.0, 0.0)]


def test_variance_conventions_share_the_trace():
    r = np.random.default_rng(1)
    n = r.poisson(5, (8, 8)).astype(float)
    k = r.poisson(n * 0.4).astype(float)
    s = kernels.spectrum((8, 8), 4.0, 0.3)
    a, b = (solver.fit(s, n, k, -1.0, variance=v) for v in ("exact", "compat"))
    assert np.isfinite(a.elbo) and np.isfinite(b.elbo) and abs(a.v.mean() - b.v.mean()) < 0.2 * a.v.mean()
