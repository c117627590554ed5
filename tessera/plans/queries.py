"""The library's operators applied to the test tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import safe, savgol
from tessera.operators import binning, fits, geometry, grids, lowrank, moments, neighbors, posterior, series, tracking
from tessera.runtime import cut, ship
from tessera.sources import fixtures, recordings, simulate

B = ["cell_id"]


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros, so that sums in any order compare."""
    return df.select(*[(F.round(f"`{f.name}`", digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema])


def _grid(s: SparkSession, d: str, size: int = 16, **kw) -> DataFrame:
    return binning.visits_and_counts(fixtures.points(s, d), size, **kw)


def _field(s: SparkSession, d: str, size: int) -> DataFrame:
    return grids.dense(binning.rates(_grid(s, d, size)), size, size, ["y"])


def rate_histogram(s, d):
    return tidy(binning.rates(_grid(s, d)))


def bin_linear(s, d):
    return tidy(_grid(s, d, 16, weight=F.col("w")))


def bin_nearest(s, d):
    return tidy(_grid(s, d, 16, method="nearest"))


def bin_linear_lattice_l(s, d):
    p = fixtures.points(s, d).where("x < 1 and y < 1")
    return tidy(binning.visits_and_counts(p, 16, open_=True))


def bin_linear_3d_wrap(s, d):
    axes = [binning.Axis("h", 6, "ih", wrap=True), *binning.square(6)]
    return tidy(binning.bin_linear(fixtures.points(s, d), axes, {"n": F.lit(1.0), "k": F.col("s")}))


def bin_weighted_reweighted(s, d):
    w = safe.heading_weight(F.col("h") * (2 * math.pi), 1.0, 2)
    return tidy(binning.reweighted(fixtures.points(s, d), 16, w))


def value_histogram_whole(s, d):
    """Counts in twelve bins of 0 to 60, with what lies below and above in bins -1 and 12."""
    e = fixtures.table(s, d, "events")
    inner = binning.histogram(e, "value", 0.0, 60.0, 12, ["event_type"])
    outer = e.where("value < 0 or value > 60").groupBy("event_type", F.when(F.col("value") < 0, -1).otherwise(12).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return inner.unionByName(outer)


def arena_geometry(s, d):
    p = fixtures.points(s, d).withColumn("x", F.col("x") * (F.col("cell_id") + 1))
    return tidy(geometry.arena(p, 64))


def unit_meter_bin_roundtrip(s, d):
    p = fixtures.points(s, d).withColumn("x", F.col("x") * (F.col("cell_id") + 1))
    a = F.broadcast(geometry.arena(p, 64))
    u = geometry.meters_to_unit(F.col("x"), F.col("x0"), F.col("x1"))
    j = p.drop("w", "h").join(a, "cell_id").withColumn("u", u)
    j = j.withColumn("b", geometry.unit_to_bins(F.col("u"), F.col("w")))
    back = geometry.unit_to_meters(geometry.bins_to_unit(F.col("b"), F.col("w")), F.col("x0"), F.col("x1"))
    return tidy(j.groupBy("cell_id").agg(F.avg("u").alias("mean_unit"), F.avg("b").alias("mean_bin"), F.max(F.abs(back - F.col("x"))).alias("worst")))


def normalised_square(s, d):
    p = fixtures.points(s, d).withColumn("x", F.col("x") * (F.col("cell_id") + 1))
    return tidy(geometry.normalised(p.select("cell_id", "x", "y")).groupBy("cell_id").agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]))


def safe_math(s, d):
    v = F.col("value")
    return tidy(fixtures.table(s, d, "events").select("event_id", safe.sexp(v / 10 - 5).alias("e"), safe.slog(v - 20).alias("l"), safe.normal_pdf(v, 20.0, 10.0).alias("pdf"), safe.decibel(v / 100, 50.0).alias("db")))


def safe_div_cases(s, d):
    rows = s.sql("select * from values (0, 0D, 0D), (1, 2D, 0D), (2, -2D, 0D), (3, 6D, 3D), (4, 0D, 5D) as t(id, a, b)")
    return rows.select(F.col("id").cast("int").alias("id"), safe.sdiv(F.col("a"), F.col("b")).alias("q"))


def lgamma_table(s, d):
    return tidy(s.range(1, 200).select("id", safe.lgamma(F.col("id") / 4.0 + 0.5).alias("v")), 5)


def unitscale_percentile(s, d):
    return tidy(moments.unitscale(fixtures.table(s, d, "events").select("event_id", "event_type", "value"), "value", 0.01, 0.99, ["event_type"]))


def lognormal_moments(s, d):
    g = _grid(s, d, 8)
    mu, v = safe.slog(F.col("k") / F.col("n")), 1 / (F.col("k") + 1)
    return tidy(g.select("cell_id", "iy", "ix", *[c.alias(n) for n, c in safe.lognormal(mu, v, 50.0).items()]))


def hex_grid(s, d):
    return tidy(simulate.hex_grid(s, 24, 8.0))


def simulated_rate_map(s, d):
    return tidy(simulate.rate_map(s, 24, 8.0))


def bin_coordinates(s, d):
    a, b = geometry.grid(s, 9, 7), geometry.grid(s, 9, 7, ends=True)
    return tidy(a.join(b.withColumnsRenamed({"y": "y_end", "x": "x_end"}), ["iy", "ix"]))


def _unit_cloud(s, d) -> DataFrame:
    e = fixtures.cloud(s, d)
    box = e.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("e"))
    return e.crossJoin(F.broadcast(box)).select("vec_id", F.col("label").alias("cell_id"), ((F.col("x") - F.col("a")) / (F.col("b") - F.col("a"))).alias("x"), ((F.col("y") - F.col("c")) / (F.col("e") - F.col("c"))).alias("y"))


def hull_edges_coarse(s, d):
    return tidy(geometry.hull(_unit_cloud(s, d)).select("cell_id", "ax", "ay", "bx", F.col("by_").alias("by")))


def in_hull(s, d):
    planes = geometry.half_planes(geometry.hull(_unit_cloud(s, d))).select(F.pmod(F.col("cell_id") + 1, F.lit(10)).alias("cell_id"), "planes")
    p = _unit_cloud(s, d).join(F.broadcast(planes), "cell_id")
    return p.select("vec_id", geometry.in_hull(F.col("x"), F.col("y"), F.col("planes")).alias("inside"))


def mask_from_hull(s, d):
    return geometry.hull_mask(geometry.hull(_unit_cloud(s, d)), 16, 16)


def _label_masks(s, d) -> DataFrame:
    bins = [F.least(F.floor(F.col(c) * 16), F.lit(15)).cast("int").alias(f"i{c}") for c in "yx"]
    return _unit_cloud(s, d).select(F.col("cell_id").cast("long").alias("cell_id"), *bins).distinct()


def mask_dilate_labels(s, d):
    return geometry.dilate(_label_masks(s, d), 2.0, 16, 16)


def spike_times_to_counts(s, d):
    return tidy(binning.spike_counts(fixtures.spikes(s, d), 3600.0, 720))


def run_edges(s, d):
    return series.run_edges(fixtures.track(s, d), F.col("s") == 1)


def run_edges_inner(s, d):
    return series.run_edges(fixtures.track(s, d), F.col("s") == 1, pad=False)


def interpolate_gaps(s, d):
    return tidy(series.fill_gaps(fixtures.track(s, d), ["x"]).select("cell_id", "t", "x"), 9)


def interpolate_gaps_linear(s, d):
    return tidy(_filled(s, d).select("cell_id", "t", "x"), 9)


def _filled(s, d) -> DataFrame:
    return series.fill_gaps(fixtures.track(s, d), ["x"], mode="linear")


def glitch_patch(s, d):
    t = fixtures.track(s, d).withColumn("x", F.coalesce("x", F.lit(0.0)))
    return tidy(series.patch_glitches(t, 0.5, mode="linear").select("cell_id", "t", "x", "y"), 9)


M, DEGREE, FS = 5, 3, 50.0


def sg_smooth(s, d):
    return tidy(series.smooth(fixtures.track(s, d), "y", "v", M, DEGREE).select("cell_id", "t", "v"))


def sg_derivative(s, d):
    return tidy(series.differentiate(fixtures.track(s, d), "y", "v", M, DEGREE, FS).select("cell_id", "t", "v"))


def heading_angle(s, d):
    return tidy(series.heading_angle(_filled(s, d), M, DEGREE, FS).select("cell_id", "t", "heading"), 5)


DRAWS = [(0, 0, 2), (0, 1, 0), (0, 2, 2), (1, 0, 1), (1, 1, 4), (1, 2, 3)]


def block_resample_fixed(s, d):
    draws = s.sql("select * from values " + ", ".join(f"({a}L, {b}L, {c}L)" for a, b, c in DRAWS) + " as t(sample_id, pos, block_id)")
    return tidy(series.resample_blocks(fixtures.track(s, d).select("cell_id", "t", "y"), draws, 8).select("cell_id", "sample_id", "pos_t", "y"))


def cv_folds(s, d):
    f = series.cross_validation(fixtures.track(s, d), 5)
    return tidy(f.groupBy("cell_id", "fold").agg(F.count_if("is_test").alias("tests"), F.avg(F.when(~F.col("is_test"), F.col("y"))).alias("train_mean")))


def learning_curve(s, d):
    return tidy(series.prefixes(fixtures.track(s, d), [10, 20, 40]).groupBy("cell_id", "used").agg(F.avg("y").alias("mean"), F.count(F.lit(1)).alias("rows")))


def circular_smooth(s, d):
    v = _grid(s, d, 16).groupBy("cell_id", F.col("ix").alias("i")).agg(F.sum("n").alias("v"))
    return tidy(series.circular_smooth(v, 1.5, 16))


def upsampled_profile(s, d):
    v = _grid(s, d, 16).groupBy("cell_id", F.col("ix").alias("i")).agg(F.sum("n").alias("v"))
    both = [series.upsample(v, 16, 3, c).withColumn("circular", F.lit(c)) for c in (False, True)]
    return tidy(both[0].unionByName(both[1]))


def blur_covariance(s, d):
    """Blurred along a direction: the packed maps by a covariance that is not diagonal."""
    return tidy(grids.unpack(fits.blurred_maps(_packed(s, d), ["n", "k"], [[3.0, 1.0], [1.0, 2.0]]), ["n", "k"]))


def kde_v1_masked(s, d):
    """The earlier estimator on the bins with more than the key's mean of samples; 0 elsewhere."""
    g = _grid(s, d, 16)
    mask = g.join(g.groupBy("cell_id").agg(F.avg("n").alias("m")), "cell_id").where("n > m + 1e-6")
    return tidy(grids.kde_biased(g, 16, 16, 2.0, mask=mask))


def blur_grid(s, d):
    return tidy(grids.blur(_grid(s, d), ["n", "k"], 16, 16, 1.5))


def kde_rate_map(s, d):
    return tidy(grids.kde(_grid(s, d), 16, 16, 2.0))


def kde_v1(s, d):
    return tidy(grids.kde_biased(_grid(s, d), 16, 16, 2.0))


def acorr_grid(s, d):
    return tidy(grids.autocorrelation(_field(s, d, 8), "y", 8, 8))


def radial_average(s, d):
    return tidy(grids.radial_average(_field(s, d, 16), "y", 16, 16))


def hartley_transform(s, d):
    return tidy(grids.hartley(_field(s, d, 8), "y", 8, 8))


def hessian_grid(s, d):
    return tidy(grids.hessian(_field(s, d, 8), "y", 8, 8))


def peaks_local_max(s, d):
    return tidy(grids.find_peaks(grids.kde(_grid(s, d), 16, 16, 1.0), "rate", 16, 16, 1.5))


def peaks_interpolated(s, d):
    return tidy(grids.interpolate_peaks(grids.kde(_grid(s, d), 16, 16, 1.0), "rate", 16, 16, 1.0), 5)


def packed_roundtrip(s, d):
    return tidy(grids.unpack(grids.pack(_grid(s, d, 8), 8, 8, ["n", "k"]), ["n", "k"]))


def _centroids(s, d) -> DataFrame:
    return _unit_cloud(s, d).groupBy(F.col("cell_id").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def nearest_point(s, d):
    return tidy(neighbors.nearest(_unit_cloud(s, d), _centroids(s, d), "id", radius=0.12).select("vec_id", "near_id", "near_distance"))


def voronoi_assign(s, d):
    return neighbors.voronoi(_unit_cloud(s, d), _centroids(s, d), "id", radius=0.3).select("vec_id", "region")


def region_moments(s, d):
    return tidy(moments.gaussians(neighbors.voronoi(_unit_cloud(s, d), _centroids(s, d), "id"), ["region"]))


def weighted_region_moments(s, d):
    p = neighbors.voronoi(_unit_cloud(s, d), _centroids(s, d), "id").withColumn("weight", F.col("x") * F.col("y"))
    return tidy(moments.weighted_gaussians(p, "weight", ["region"]))


def _layers(s, d) -> DataFrame:
    return _unit_cloud(s, d).select(F.col("cell_id").alias("layer"), F.col("vec_id").alias("id"), "x", "y")


def _mutual(s, d) -> DataFrame:
    a = _layers(s, d)
    return neighbors.mutual_nearest(a, a.withColumn("layer", F.pmod(F.col("layer") - 1, F.lit(10))), ["layer"])


def mutual_nn_round1(s, d):
    return tidy(_mutual(s, d))


def match_adjacent_layers(s, d):
    return tidy(neighbors.match_layers(_layers(s, d), 10, 0.1))


def chain_components(s, d):
    pairs = _mutual(s, d).where("dist < 0.02").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return neighbors.components(pairs)


def _clustered(s, d) -> DataFrame:
    """The cloud drawn towards its corner by fourth powers."""
    power = lambda c: (F.col(c) * F.col(c) * F.col(c) * F.col(c)).alias(c)
    return _unit_cloud(s, d).select(F.col("vec_id").alias("id"), power("x"), power("y"))


def nearest_clustered(s, d):
    """The closest of as many clustered points, by the tree of squares split by counts."""
    return tidy(neighbors.nearest(_unit_cloud(s, d), _clustered(s, d), "id", radius=0.2, small=0).select("vec_id", "near_id", "near_distance"))


def alias_flags_clustered(s, d):
    return neighbors.alias_flags(_unit_cloud(s, d), _clustered(s, d), "id", factor=1.2, small=0).select("vec_id", "aliased")


def alias_flags(s, d):
    return neighbors.alias_flags(_unit_cloud(s, d), _centroids(s, d), "id").select("vec_id", "aliased")


def confidence_ellipse(s, d):
    g = moments.gaussians(_unit_cloud(s, d), ["cell_id"]).drop("n")
    return tidy(geometry.ellipse(g, 0.95, 12))


def map_similarity(s, d):
    p = fixtures.points(s, d)
    a = binning.rates(binning.visits_and_counts(p.where("h < 0.4"), 8)).select("cell_id", "iy", "ix", F.col("y").alias("a"))
    b = binning.rates(binning.visits_and_counts(p.where("h >= 0.4"), 8)).select("cell_id", "iy", "ix", F.col("y").alias("b"))
    return tidy(moments.map_similarity(a.join(b, ["cell_id", "iy", "ix"]), "a", "b", B))


def poisson_deviance_cv(s, d):
    p = fixtures.points(s, d)
    train, test = binning.visits_and_counts(p.where("h < 0.4"), 8), binning.visits_and_counts(p.where("h >= 0.4"), 8)
    rate = train.select("cell_id", "iy", "ix", ((F.col("k") + 0.5) / (F.col("n") + 1)).alias("rate"))
    return tidy(moments.deviance_scores(test.join(rate, ["cell_id", "iy", "ix"]), B, 50.0))


def density_rgb_mix(s, d):
    g = grids.blur(_grid(s, d, 8), ["n", "k"], 8, 8, 1.0)
    return tidy(moments.rgb_mix(g, ["n", "k"], [(1.0, 0.5, 0.0), (0.0, 0.5, 1.0)], B))


def estimator_spread(s, d):
    p = fixtures.points(s, d).withColumn("sample", F.round(F.col("h") * 7).cast("int"))
    each = binning.rates(binning.visits_and_counts(p, 6, by=["cell_id", "sample"])).select("cell_id", "sample", "iy", "ix", F.col("y").alias("estimate"))
    whole = binning.rates(binning.visits_and_counts(p, 6)).select("cell_id", "iy", "ix", F.col("y").alias("truth"))
    return tidy(moments.estimator_spread(each.join(whole, ["cell_id", "iy", "ix"]), B))


def streaming_counts_batch(s, d):
    from tessera.streaming.rates import windowed_counts

    e = fixtures.table(s, d, "events").where("value is not null").select(
        "ts", (F.col("user_id") % 3).alias("cell_id"), F.least(F.col("value") / 100, F.lit(1.0)).alias("x"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("y"),
        F.when(F.col("event_type") == "click", 1.0).otherwise(0.0).alias("s"),
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    return tidy(windowed_counts(e, 8, window="7 days").withColumn("start", F.unix_seconds("start")))


def _packed(s, d, size: int = 16) -> DataFrame:
    return grids.pack(_grid(s, d, size), size, size, ["n", "k"])


def lgcp_fit_map(s, d):
    return fits.fit_maps(_packed(s, d))


def _swept(s, d) -> DataFrame:
    grid = s.range(9).select(
        F.col("id").alias("param_id"), (F.floor(F.col("id") / 3) * 2.0 + 4).alias("period"), F.pow(F.lit(10.0), F.col("id") % 3 - 2).alias("variance"), F.lit(0.0).alias("angle")
    )
    return fits.sweep(_packed(s, d), grid)


def lgcp_elbo_sweep(s, d):
    return tidy(_swept(s, d), 5)


def lgcp_hill_climb(s, d):
    return fits.climb(_packed(s, d), [4.0, 5.0, 6.0, 7.0, 8.0], [0.01, 0.03, 0.1, 0.3])


def lgcp_posterior_samples(s, d):
    return fits.posterior_samples(_packed(s, d), 8, 3)


def lgcp_heading_fit(s, d):
    return fits.fit_headings(_joint_packed(s, d), 6)


def laplace_confidence(s, d):
    return tidy(fits.laplace_peaks(_packed(s, d)), 4)


def linear_gp(s, d):
    return fits.linear_maps(_packed(s, d), 2.0)


def sampled_confidence(s, d):
    return tidy(posterior.sampled_confidence(fits.posterior_samples(_packed(s, d), 24, 3), 16, 6.0), 9)


def fraction_within_arena(s, d):
    g = moments.gaussians(_unit_cloud(s, d), ["cell_id"]).drop("n").withColumn("field", F.lit(0).cast("long"))
    return tidy(posterior.fraction_inside(g, geometry.half_planes(geometry.hull(_unit_cloud(s, d)))))


def laplace_joint(s, d):
    return tidy(posterior.joint_confidence(_packed(s, d)), 4)


def laplace_joint_rate(s, d):
    return tidy(posterior.joint_confidence(_packed(s, d), domain="rate"), 4)


def elbo_profiles(s, d):
    return tidy(posterior.profiles(_swept(s, d), "variance"), 5)


def heading_variance(s, d):
    maps = tracking.heading_maps(fixtures.points(s, d).withColumn("a", F.col("h") * (2 * math.pi)), "a", 4, 12)
    packed = grids.pack(maps, 12, 12, ["n", "k"], ["cell_id", "layer"])
    return tidy(posterior.heading_variance(packed, [0.3, 1.0, 3.0], 5.0, 0.05, 0.0, ["cell_id", "layer"]), 5)


def heading_rate_maps(s, d):
    p = fixtures.points(s, d).withColumn("a", F.col("h") * (2 * math.pi))
    return tidy(tracking.heading_maps(p, "a", 4, 8, 2))


def heading_peaks(s, d):
    p = fixtures.points(s, d).withColumn("a", F.col("h") * (2 * math.pi))
    return tracking.heading_peaks(p, "a", 4, 12)


def tracked_chains(s, d):
    layers = _layers(s, d)
    edges = neighbors.match_layers(layers, 10, 0.08)
    paths = tracking.link_peaks(neighbors.chains(edges, 10, 3), layers, 10, 0.3, 2.0)
    return tidy(tracking.path_regions(paths, _centroids(s, d)))


def tracked_matches_labels(s, d):
    """Every label's rows matched to the next label's; each pair of labels lies in a strip of its own."""
    a = _unit_cloud(s, d)
    part = lambda k: a.select(F.col("vec_id").alias("id"), (F.col("x") + (F.col("cell_id") - k) * 4).alias("x"), "y")
    return tidy(tracking.tracked_matches(part(0), part(1), 0.2))


def mahalanobis_displacement(s, d):
    g = moments.gaussians(_unit_cloud(s, d), ["cell_id"]).drop("n")
    j = _unit_cloud(s, d).join(F.broadcast(g), "cell_id")
    return tidy(tracking.displacement(j.withColumn("dx", F.col("x") - F.col("mx")).withColumn("dy", F.col("y") - F.col("my"))).select("vec_id", "displacement"))


def prior_draws(s, d):
    return posterior.prior_draws(s, 3, 16, 6.0, 0.5)


def scalar_variational(s, d):
    rows = _grid(s, d, 4).select("cell_id", "iy", "ix", F.lit(0.0).alias("m"), F.lit(1.0).alias("p"), F.round(F.col("k") / 100).alias("y"))
    return tidy(posterior.scalar_fits(rows, "m", "p", "y"))


def zero_lag(s, d):
    return tidy(posterior.zero_lag(grids.radial_average(_field(s, d, 16), "y", 16, 16), "y"))


def box_statistics(s, d):
    return tidy(posterior.box_statistics(fixtures.table(s, d, "events"), "value", ["event_type"]))


def kde_packed(s, d):
    return tidy(grids.unpack(fits.kde_maps(_packed(s, d), 2.0), ["rate"]))


def heuristic_parameters(s, d):
    return tidy(fits.heuristics(_packed(s, d)))


def autocorrelation_profile(s, d):
    return tidy(fits.radial_profiles(_packed(s, d)), 9)


def _joint_packed(s, d, layers: int = 6, size: int = 12) -> DataFrame:
    axes = [binning.Axis("h", layers, "ih", wrap=True), *binning.square(size)]
    g = binning.bin_linear(fixtures.points(s, d), axes, {"n": F.lit(1.0), "k": F.col("s")})
    flat = g.select("cell_id", (F.col("ih") * size + F.col("iy")).cast("int").alias("iy"), "ix", "n", "k")
    return grids.pack(flat, layers * size, size, ["n", "k"]).withColumn("d", F.lit(layers)).withColumn("h", F.lit(size))


def heading_density(s, d):
    return tidy(posterior.heading_density(_joint_packed(s, d, 4, 12), 8, 12, 5.0))


def heading_confidence(s, d):
    p = fixtures.points(s, d).withColumn("a", F.col("h") * (2 * math.pi))
    keys = ["cell_id", "layer"]
    packed = grids.pack(tracking.heading_maps(p, "a", 4, 12), 12, 12, ["n", "k"], keys)
    planes = geometry.half_planes(geometry.hull(fixtures.points(s, d).select("cell_id", "x", "y")))
    return tidy(posterior.heading_confidence(packed, planes, 12, 12, 5.0, keys, edge=0.1, height=0.5))


def prepared_maps(s, d):
    """Samples to binned maps with kernel-density estimates and prior means (long form)."""
    p = fixtures.points(s, d).select("cell_id", (F.col("x") * 1.5 - 0.2).alias("x"), "y", "s")
    return tidy(grids.unpack(fits.prepare(p, 16), ["n", "k", "y", "kde", "prior_mean", "kde_log"]))


def regressed_maps(s, d):
    return tidy(fits.regress(_packed(s, d, 12), 50.0), 5)


def best_parameters(s, d):
    return tidy(fits.optimise(_packed(s, d, 12), [4.0, 6.0], [0.01, 0.1], [0.0, 0.5], oriented=True), 5)


def early_spectrum(s, d):
    from tessera.functions import kernels

    f = kernels.early_spectrum(8, 4.0, 0.5, 2)
    return tidy(s.createDataFrame([(i, j, float(f[i, j])) for i in range(8) for j in range(8)], "iy int, ix int, value double"))


def expected_maps(s, d):
    return tidy(simulate.expected_maps(s, 24, 8.0))


def simulated_counts(s, d):
    maps = simulate.expected_maps(s, 24, 8.0, mean=0.5).select("iy", "ix", F.col("background").alias("rate"), (F.col("visits") * 20).alias("visits"))
    return simulate.counts(maps, None, 4)


def simulated_explorations(s, d):
    return simulate.explorations(s, 2, 30.0, 50.0, 0.2, size=32)


def kernel_covariance(s, d):
    """Covariance between the bins of a 4 x 4 grid of a kernel repaired to a spectrum of at least 0.5."""
    from tessera.functions import kernels, numerics

    c = kernels.block_covariance(kernels.ensure_psd(numerics.gaussian(4, 4, 1.2), 0.5))
    return tidy(s.createDataFrame([(i, j, float(c[i, j])) for i in range(16) for j in range(16)], "a int, b int, value double"))


STYLES = ["radial", "grid", "band", "square", "rbf"]


def grid_kernel(s, d):
    """Every style of the prior kernel on an 8 x 8 grid, one kernel a task."""
    from tessera.functions import kernels

    ship(s)

    def make(batches):
        for b in batches:
            for style in b["style"]:
                k = kernels.grid_kernel(4.0, (8, 8), style, 0.3, zero=2)
                iy, ix = np.divmod(np.arange(64), 8)
                yield pd.DataFrame({"style": style, "iy": iy, "ix": ix, "value": k.ravel()})

    rows = s.sql("select * from values " + ", ".join(f"('{x}')" for x in STYLES) + " as t(style)")
    return tidy(rows.mapInPandas(make, "style string, iy int, ix int, value double"))


def recording_track(s, d):
    """The events' series as recordings with rates of their own: pixels to metres, event samples shared, jumps beyond each recording's sample time patched."""
    t = fixtures.track(s, d).select("cell_id", "t", (F.coalesce("x", F.lit(0.0)) * 0.2).alias("x"), (F.col("y") * 0.01).alias("y"), "s")
    meta = t.select("cell_id").distinct().select("cell_id", (F.lit(2.0) + (F.col("cell_id") % 3) * 4).alias("pos_rate"), F.lit(300.0).alias("px_per_m"), F.lit(96000.0).alias("spk_rate"))
    samples = t.select("cell_id", "t", (F.col("x") * 300).alias("x_px"), (F.col("y") * 300).alias("y_px"))
    spikes = t.where("s = 1").join(meta, "cell_id").select("cell_id", ((F.col("t") + (F.col("t") % 5) / 4) / F.col("pos_rate") * 96000).alias("spike_sample"))
    return tidy(recordings.track(samples, spikes, meta))


def silent_recordings(s, d):
    t = fixtures.track(s, d)
    return recordings.silent(t.where("y > 0.97").select("cell_id"), t.select("cell_id"))


def locate_opposites(s, d):
    layers = _layers(s, d)
    return tidy(neighbors.opposite(neighbors.match_layers(layers, 10, 0.1), 10, 0, 0.5, layers))


def cardinal_nodes(s, d):
    chained = neighbors.chains(neighbors.match_layers(_layers(s, d), 10, 0.08), 10, 3)
    return neighbors.cardinal_points(chained, {"east": 0, "north": 2, "west": 5, "south": 7})


def chain_positions(s, d):
    return neighbors.chains(neighbors.match_layers(_layers(s, d), 10, 0.08), 10, 3)


def linked_edges(s, d):
    layers = _layers(s, d)
    paths = tracking.link_peaks(neighbors.chains(neighbors.match_layers(layers, 10, 0.08), 10, 3), layers, 10, 0.02)
    return tracking.linked_edges(paths)


def rates_at_points(s, d):
    p = fixtures.points(s, d).select("cell_id", F.least(F.floor(F.col("y") * 16), F.lit(15)).cast("int").alias("iy"), F.least(F.floor(F.col("x") * 16), F.lit(15)).cast("int").alias("ix"), "s")
    met = neighbors.at_bins(p, grids.kde(_grid(s, d), 16, 16, 2.0), B)
    return tidy(met.groupBy("cell_id").agg(F.avg("rate").alias("mean_rate"), F.avg(F.col("rate") * F.col("s")).alias("at_events")))


def head_direction(s, d):
    t = fixtures.track(s, d).withColumn("dir", F.col("y") * 360)
    return tidy(series.head_direction(t, "dir", M, DEGREE).select("cell_id", "t", "direction"), 5)


def skip_statistics(s, d):
    """Sums and means that skip NaN and null, with a default where nothing is left."""
    v = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("value"))
    rows = fixtures.table(s, d, "events").select("event_type", v.alias("v"), F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(v).alias("u"))
    return tidy(rows.groupBy("event_type").agg(safe.skip_sum(F.col("v")).alias("total"), safe.skip_mean(F.col("v")).alias("mean"), safe.skip_mean(F.col("u"), -1.0).alias("mean_or")))


def zscored(s, d):
    e = fixtures.table(s, d, "events").where("value is not null")
    w = Window.partitionBy("event_type")
    return tidy(e.select("event_id", "event_type", safe.zscore(F.col("value"), F.avg("value").over(w), F.stddev_pop("value").over(w)).alias("z"), (F.col("value") - F.avg("value").over(w)).alias("centred")))


def pending_keys(s, d):
    """Keys that a store of fits lacks; the store holds the keys with a low sample."""
    t = fixtures.track(s, d)
    return recordings.missing(t.select("cell_id").distinct(), t.where("y < 0.03"), B)


def ends_mask(s, d):
    return geometry.hull_mask(geometry.hull(_unit_cloud(s, d)), 12, 12, ends=True)


def mask_hull(s, d):
    """Hull of each label's mask of bins (bin centres in the unit square)."""
    return tidy(geometry.mask_hull(_label_masks(s, d), 16, 16).select("cell_id", "ax", "ay", "bx", F.col("by_").alias("by")))


def arena_of_mask(s, d):
    return tidy(geometry.arena_of_mask(_label_masks(s, d), 16, 16, 3))


def boundary_distance_labels(s, d):
    return tidy(_label_distances(s, d).select("cell_id", "point_id", "distance"))


def near_boundary_filter_labels(s, d):
    return _label_distances(s, d).where(F.abs("distance") > 1.0).select("cell_id", "point_id")


def _label_distances(s, d) -> DataFrame:
    cell = lambda c: F.least(F.floor(F.col(c) * 16), F.lit(15)).cast("int").alias(f"i{c}")
    p = _unit_cloud(s, d).select(F.pmod(F.col("cell_id") + 1, F.lit(10)).cast("long").alias("cell_id"), F.col("vec_id").alias("point_id"), (F.col("x") * 16 - 0.5).alias("bx"), (F.col("y") * 16 - 0.5).alias("by_"), cell("y"), cell("x"))
    return geometry.boundary_distance(p, _label_masks(s, d), 16, 16)


def contains_units(s, d):
    """Points of the next label's hull told in unit, bin and metre coordinates."""
    planes = geometry.half_planes(geometry.hull(_unit_cloud(s, d))).select(F.pmod(F.col("cell_id") + 1, F.lit(10)).alias("cell_id"), "planes")
    p = _unit_cloud(s, d).join(F.broadcast(planes), "cell_id")
    box = [F.lit(x) for x in (-1.0, 3.0, 2.0, 4.0)]
    return p.select("vec_id", *[geometry.contains(x, y, F.col("planes"), unit, 20, 30, box).alias(unit) for unit, x, y in (
        ("unit", F.col("x"), F.col("y")), ("bin", F.col("x") * 30, F.col("y") * 20), ("meter", F.col("x") * 4 - 1, F.col("y") * 2 + 2))])


def physical_units(s, d):
    p = _unit_cloud(s, d)
    return tidy(p.select("vec_id", *geometry.physical(F.col("x"), F.col("y"), 0.8, 0.4, 0.6)))


def centred_grid(s, d):
    return tidy(geometry.centred(s, 6, 9))


def masked_rates(s, d):
    """Rates on visited bins only: others null (a mask of ones and nulls)."""
    g = grids.dense(_grid(s, d, 16, method="nearest"), 16, 16, ["n", "k"])
    return tidy(g.select("cell_id", "iy", "ix", (safe.null_mask(F.col("n") > 20) * safe.sdiv(F.col("k"), F.col("n"))).alias("rate")))


def elbo_bits(s, d):
    """Bits a second of given bounds: with the ln Gamma correction of the counts."""
    g = _grid(s, d, 8).withColumn("y", F.col("k") / F.col("n"))
    per = moments.elbo_bits(g, F.lit(-1000.0) - F.col("cell_id"), 50.0, B)
    return tidy(per, 5)


def bessel_variance(s, d):
    from tessera.functions.numerics import bessel_variance as scale

    rows = [(k, *pair, scale(*pair)) for k, pair in enumerate([(0.05, 0.01), (0.1, 0.02), (0.02, 0.001)])]
    return tidy(s.createDataFrame(rows, "id int, mean double, observed double, variance double"))


def simulated_background(s, d):
    """The rate map with a background that falls off from the middle."""
    from tessera.sources.simulate import background_map

    rate = background_map(24, 8.0)
    return tidy(s.createDataFrame([(i, j, float(rate[i, j])) for i in range(24) for j in range(24)], "iy int, ix int, rate double"))


def peak_filters(s, d):
    """Peaks inside the key's hull, away from the edge, above the key's median height."""
    peaks = grids.interpolate_peaks(grids.kde(_grid(s, d), 16, 16, 1.0), "rate", 16, 16, 1.0)
    planes = geometry.half_planes(geometry.hull(_unit_cloud(s, d)))
    out = posterior.filter_peaks(peaks, planes, edge=0.05, quantile=0.5)
    return tidy(out.select("cell_id", "iy", "ix", "x", "y", "height"), 5)


def truncated_spectrum(s, d):
    """Frequencies of a long-form spectrum at a tenth of the largest other one or above, and the top ones by value."""
    h = grids.hartley(_field(s, d, 8), "y", 8, 8).withColumn("power", F.col("c") * F.col("c"))
    return tidy(grids.retained(h, "power", ["ky", "kx"], 0.1).select("cell_id", "ky", "kx", "power"), 9)


def top_frequencies(s, d):
    h = grids.hartley(_field(s, d, 8), "y", 8, 8).select("cell_id", "ky", "kx", F.round(F.col("c") * F.col("c"), 9).alias("power"))
    return tidy(grids.top_frequencies(h, "power", ["ky", "kx"], 10).select("cell_id", "ky", "kx", "power"), 9)


def upsampled_field(s, d):
    return tidy(grids.unpack(fits.upsampled(grids.pack(_field(s, d, 8), 8, 8, ["y"]), "y", 2), ["y"]))


def noise_draw_blocks(s, d):
    """Shape of seeded block draws: every sample has blocks + 1 draws with replacement or a permutation without."""
    a = series.random_draws(s, 3, 5, True, 1).groupBy("sample_id").agg(F.count(F.lit(1)).alias("draws"), F.lit(True).alias("replace"), F.lit(0).cast("long").alias("distinct_blocks"))
    b = series.random_draws(s, 3, 5, False, 1).groupBy("sample_id").agg(F.count(F.lit(1)).alias("draws"), F.lit(False).alias("replace"), F.countDistinct("block_id").alias("distinct_blocks"))
    return a.unionByName(b)


def overlapping_folds(s, d):
    f = series.edge_folds(fixtures.track(s, d), 5)
    return tidy(f.groupBy("cell_id", "fold").agg(F.count_if("is_test").alias("tests"), F.avg(F.when(~F.col("is_test"), F.col("y"))).alias("train_mean")))


def point_pairs(s, d):
    """Repeated mutual matches of two point sets within a radius."""
    a = _layers(s, d)
    return tidy(neighbors.match(a, a.withColumn("layer", F.pmod(F.col("layer") - 5, F.lit(10))), ["layer"], 0.06))


def bootstrap_draws(s, d):
    """How often each of 200 resamples takes each of 15 blocks; as many keys as events have users."""
    keys = fixtures.track(s, d).select((F.col("cell_id") % 3).alias("cell_id")).distinct()
    return series.bootstrap_weights(s, 200, 15, 7).crossJoin(F.broadcast(keys))


def _block_maps(s, d, size: int = 6, blocks: int = 15) -> DataFrame:
    """Maps of the events' places for each of three groups of users and each block of the time."""
    e = fixtures.table(s, d, "events").where("value is not null")
    ends = e.agg(F.min("event_id").alias("a"), (F.max("event_id") - F.min("event_id") + 1).alias("span"))
    p = e.crossJoin(F.broadcast(ends)).select(
        (F.col("user_id") % 3).cast("long").alias("cell_id"), F.floor((F.col("event_id") - F.col("a")) * blocks / F.col("span")).cast("long").alias("block_id"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("x"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("y"), F.when(F.col("event_type") == "click", 1.0).otherwise(0.0).alias("s"),
    )
    return binning.visits_and_counts(p, size, by=["cell_id", "block_id"])


def bootstrap_spread(s, d):
    """Variance and bias over 200 block resamples of the smoothed rate, against that of all samples."""
    maps = cut(_block_maps(s, d))
    rate = (F.col("k") + 0.5) / (F.col("n") + 1)
    each = series.bootstrap_maps(maps, series.bootstrap_weights(s, 200, 15, 7), ["n", "k"]).select("cell_id", "sample_id", "iy", "ix", rate.alias("estimate"))
    whole = maps.groupBy("cell_id", "iy", "ix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).select("cell_id", "iy", "ix", rate.alias("truth"))
    return tidy(moments.estimator_spread(each.join(whole, ["cell_id", "iy", "ix"]), B))


def shared_frequencies(s, d):
    """Frequencies that any of a set of settings around the keys' own periods keeps on a 16 x 16 grid."""
    own = fits.heuristics(_packed(s, d)).select("period").distinct()
    grid = own.select("period", F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("step")).select(F.greatest(F.col("period") * (F.col("step") * 0.05 + 1), F.lit(2.0)).alias("period"), F.lit(1.0).alias("variance"), F.lit(0.0).alias("angle"))
    return fits.frequency_words(grid, [(16, 16)], "radial")


def hyperparameters(s, d):
    """Three stages of a fit of period, variance and angle per key, on one set of frequencies."""
    return tidy(fits.hyperparameters(_packed(s, d, 12), periods=7, variances=5, angles=6))


def fit_series(s, d):
    """One fit a heading angle and key, each from the one before."""
    maps = tracking.heading_maps(fixtures.points(s, d).withColumn("a", F.col("h") * (2 * math.pi)), "a", 6, 12)
    fitted = fits.fit_series(grids.pack(maps, 12, 12, ["n", "k"], ["cell_id", "layer"]), "layer")
    return tidy(fitted.select("cell_id", "layer", "elbo", "period", "variance", F.array_max("log_rate").alias("peak"), F.array_min("log_var").alias("surest")), 5)


def posterior_at_points(s, d):
    """Mean, variance and covariance with the middle of each fitted map at the places of the other table's points."""
    rows = cut(lowrank.posterior(_packed(s, d)))
    p = _unit_cloud(s, d).select(F.pmod("cell_id", F.lit(4)).cast("long").alias("cell_id"), F.col("vec_id").alias("point_id"), F.array(F.col("y") * 15, F.col("x") * 15).alias("at"), F.array(F.lit(7.5), F.lit(7.5)).alias("to"))
    return tidy(lowrank.moments_at(rows, p))


def fitted_bins(s, d):
    """Rates and moments of the log rate at every bin of one fit per key."""
    return tidy(grids.unpack(fits.fit_maps(_packed(s, d)), ["rate", "log_rate", "log_var"]), 5)


def banded_fits(s, d):
    """Fits on the frequencies down to a hundredth of the largest value, without a constant's share of the prior."""
    fitted = fits.fit_maps(_packed(s, d, 12), "banded")
    return tidy(fitted.select("cell_id", "elbo", "period", "variance", F.array_max("log_rate").alias("peak"), F.array_min("log_var").alias("surest")), 5)


def linear_gp_bins(s, d):
    """The linear Gaussian process and its closed-form filter at every bin."""
    return tidy(grids.unpack(fits.linear_maps(_packed(s, d), 2.0), ["rate", "filtered"]), 5)


def _third_peaks(s, d) -> DataFrame:
    """The cloud as peaks of eight samples of three maps."""
    third = F.pmod("vec_id", F.lit(3)).cast("long")
    return _unit_cloud(s, d).select(third.alias("cell_id"), F.pmod(F.floor(F.col("vec_id") / 3), F.lit(8)).alias("sample_id"), "vec_id", F.col("cell_id").alias("label"), "x", "y")


def _third_fields(s, d) -> tuple[DataFrame, DataFrame]:
    p = _third_peaks(s, d)
    fields = p.groupBy("cell_id", F.col("label").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    owned = posterior.members(p, fields, 0.15)
    counts = p.groupBy("cell_id").agg(F.countDistinct("sample_id").alias("count"))
    planes = geometry.half_planes(geometry.hull(p))
    return owned, posterior.field_statistics(owned, counts, planes, edge=0.1, least=0.5, localisation=0.11)


def field_filters(s, d):
    """Fields of sampled peaks by hull and edge, probability and localisation."""
    return tidy(_third_fields(s, d)[1])


def field_members(s, d):
    """The sampled peaks that belong to the fields left by the filters."""
    owned, fields = _third_fields(s, d)
    return owned.join(fields.select("cell_id", "field"), ["cell_id", "field"]).select("cell_id", "field", "sample_id", "vec_id")


def sampled_fields(s, d):
    """From draws of the fits to filtered fields, in one path."""
    planes = geometry.half_planes(geometry.hull(fixtures.points(s, d).select("cell_id", "x", "y")))
    return tidy(posterior.sample_fields(fits.posterior_samples(_packed(s, d), 24, 3), 16, 6.0, planes, edge=0.03, height=0.25, least=0.1, localisation=0.2)[0], 9)


def heading_quadratic(s, d):
    """Laplace confidence of fields at each heading under the joint fit."""
    return tidy(posterior.heading_quadratic(_joint_packed(s, d)).drop("links"))


NAMES = [
    "kde_packed", "heuristic_parameters", "autocorrelation_profile",
    "sampled_confidence", "fraction_within_arena", "laplace_joint", "laplace_joint_rate", "elbo_profiles", "heading_variance", "heading_rate_maps", "heading_peaks",
    "tracked_chains", "tracked_matches_labels", "mask_dilate_labels", "value_histogram_whole", "mahalanobis_displacement", "prior_draws", "scalar_variational", "zero_lag", "box_statistics",
    "rate_histogram", "bin_linear", "bin_nearest", "bin_linear_lattice_l", "bin_linear_3d_wrap", "bin_weighted_reweighted", "arena_geometry",
    "unit_meter_bin_roundtrip", "normalised_square", "safe_math", "safe_div_cases", "lgamma_table", "unitscale_percentile", "lognormal_moments", "hex_grid",
    "simulated_rate_map", "bin_coordinates", "hull_edges_coarse", "in_hull", "mask_from_hull",
    "spike_times_to_counts", "run_edges", "run_edges_inner", "interpolate_gaps", "interpolate_gaps_linear", "glitch_patch", "sg_smooth", "sg_derivative", "heading_angle",
    "block_resample_fixed", "cv_folds", "learning_curve", "circular_smooth", "blur_grid", "kde_rate_map", "kde_v1", "kde_v1_masked", "blur_covariance", "upsampled_profile", "acorr_grid", "radial_average", "hartley_transform",
    "hessian_grid", "peaks_local_max", "peaks_interpolated", "packed_roundtrip", "nearest_point", "voronoi_assign", "region_moments", "weighted_region_moments",
    "mutual_nn_round1", "match_adjacent_layers", "chain_components", "alias_flags", "nearest_clustered", "alias_flags_clustered", "confidence_ellipse", "map_similarity", "poisson_deviance_cv", "density_rgb_mix",
    "estimator_spread", "streaming_counts_batch", "lgcp_fit_map", "lgcp_elbo_sweep", "lgcp_hill_climb", "lgcp_posterior_samples", "lgcp_heading_fit", "laplace_confidence", "linear_gp",
    "grid_kernel", "recording_track", "silent_recordings", "locate_opposites", "cardinal_nodes", "chain_positions", "linked_edges", "rates_at_points", "head_direction", "skip_statistics", "zscored",
    "pending_keys", "ends_mask", "mask_hull", "arena_of_mask", "boundary_distance_labels", "near_boundary_filter_labels", "contains_units", "physical_units", "centred_grid", "masked_rates",
    "elbo_bits", "bessel_variance", "simulated_background", "peak_filters", "truncated_spectrum", "top_frequencies", "upsampled_field", "noise_draw_blocks", "overlapping_folds", "point_pairs",
    "heading_density", "heading_confidence", "prepared_maps", "regressed_maps", "best_parameters", "early_spectrum",
    "expected_maps", "simulated_counts", "simulated_explorations",
    "kernel_covariance", "bootstrap_draws", "bootstrap_spread", "shared_frequencies", "hyperparameters", "fit_series", "posterior_at_points",
    "fitted_bins", "banded_fits", "linear_gp_bins", "field_filters", "field_members", "sampled_fields", "heading_quadratic",
]
QUERIES = {n: globals()[n] for n in NAMES}
