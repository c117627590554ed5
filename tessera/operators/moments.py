"""Grouped moments, similarity of maps and Poisson scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.safe import lgamma, rescaled, slog
from tessera.runtime import cut


def gaussians(points: DataFrame, by: list[str], population: bool = False) -> DataFrame:
    """n, mx, my and covariance xx, xy, yy of x and y (sample: null for one point)."""
    var, cov = (F.var_pop, F.covar_pop) if population else (F.var_samp, F.covar_samp)
    one = F.count(F.lit(1)) > (0 if population else 1)
    moments = [F.when(one, c).alias(n) for n, c in (("xx", var("x")), ("xy", cov("x", "y")), ("yy", var("y")))]
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), *moments)


def weighted_gaussians(points: DataFrame, weight: str, by: list[str]) -> DataFrame:
    """total, mx, my, xx, xy, yy with weights; groups without weight are dropped.  One pass over centred sums would need
    the mean first, so means are joined back by key and the second pass sums centred products."""
    w, x, y = F.col(weight), F.col("x"), F.col("y")
    mean = points.groupBy(*by).agg(F.sum(w).alias("total"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy")).where("total > 0")
    mean = mean.select(*by, "total", (F.col("sx") / F.col("total")).alias("mx"), (F.col("sy") / F.col("total")).alias("my"))
    dx, dy = x - F.col("mx"), y - F.col("my")
    share = w / F.col("total")
    return points.join(mean, by).groupBy(*by, "total", "mx", "my").agg(F.sum(share * dx * dx).alias("xx"), F.sum(share * dx * dy).alias("xy"), F.sum(share * dy * dy).alias("yy"))


def map_similarity(maps: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """nmse = mean (a - b)^2 / mean a^2 and Pearson's r."""
    d = F.col(a) - F.col(b)
    return maps.groupBy(*by).agg((F.avg(d * d) / F.avg(F.col(a) * F.col(a))).alias("nmse"), F.corr(a, b).alias("r"))


def poisson_bits(n: Column, y: Column, rate: Column, fs: float = 1.0) -> Column:
    """Aggregate: sum n (y ln rate - rate) / sum n, in bits a second."""
    return F.sum(n * (y * slog(rate) - rate)) / F.sum(n) * (fs / math.log(2))


def poisson_bits_normalised(n: Column, k: Column, rate: Column, fs: float = 1.0) -> Column:
    """As poisson_bits with the ln Gamma(k + 1) term of the counts."""
    return F.sum(k * slog(rate) - n * rate - lgamma(k + 1)) / F.sum(n) * (fs / math.log(2))


def expected_bits(n: Column, y: Column, mu: Column, v: Column, fs: float = 1.0) -> Column:
    """Expected Poisson score of a log-normal rate."""
    return F.sum(n * (y * mu - F.exp(mu + v / 2))) / F.sum(n) * (fs / math.log(2))


def elbo_bits(grid: DataFrame, elbo: Column, fs: float, by: list[str]) -> DataFrame:
    """A fit's evidence lower bound (nats a data set, without the constant of the counts) in bits a second: over all visits n,
    less the mean of ln Gamma(y + 1) weighted by them."""
    n = F.sum("n")
    constant = F.sum(F.col("n") * lgamma(F.col("y") + 1)) / n
    return grid.groupBy(*by).agg(((F.max(elbo) / n - constant) * (fs / math.log(2))).alias("bits"))


def deviance_scores(test: DataFrame, by: list[str], fs: float = 1.0) -> DataFrame:
    """ll, null_ll, saturated_ll (bits a second), delta and explained of test(n, k, rate); rates are scaled to the test mean."""
    totals = test.groupBy(*by).agg((F.sum("k") / F.sum("n")).alias("mean"), (F.sum(F.col("n") * F.col("rate")) / F.sum("n")).alias("mr"))
    scaled = test.join(totals, by).withColumn("fit", F.col("rate") * F.col("mean") / F.col("mr")).withColumn("y", F.col("k") / F.col("n"))
    n, y = F.col("n"), F.col("y")
    out = scaled.groupBy(*by).agg(
        poisson_bits(n, y, F.col("fit"), fs).alias("ll"), poisson_bits(n, y, F.col("mean"), fs).alias("null_ll"), poisson_bits(n, y, y, fs).alias("saturated_ll")
    )
    gain, whole = F.col("ll") - F.col("null_ll"), F.col("saturated_ll") - F.col("null_ll")
    return out.withColumn("delta", gain).withColumn("explained", F.try_divide(gain, whole))


def estimator_spread(resamples: DataFrame, by: list[str]) -> DataFrame:
    """Over resamples of estimate / truth per bin: mean variance and mean bias in percent."""
    ratio = F.col("estimate") / F.col("truth")
    bins = resamples.groupBy(*by, "iy", "ix").agg(F.var_pop(ratio).alias("v"), F.avg(ratio).alias("m"))
    return bins.groupBy(*by).agg(F.avg("v").alias("variance"), (F.avg(F.col("m") - 1) * 100).alias("bias_percent"))


def quantiles(values: DataFrame, column: str, shares: list[float], by: list[str]) -> DataFrame:
    """(by, n, q): exact quantiles, linear between ranks, of the values that are not null.

    Distinct values are counted with partial sums and dealt by ranges of (by, value), so a group with most of the rows
    spreads over many tasks; ranks are running sums inside a range plus the range's offset in its group (checkpointed, so
    that both come from one dealing).  What is left a group are the rows at the ranks asked for."""
    keys = by or ["_all"]
    rows = values if by else values.withColumn("_all", F.lit(0))
    counted = rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_c"))
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(counted.repartitionByRange(parts, *keys, column).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "_part").agg(F.sum("_c").alias("_m"))  # one row a group and range that it reaches into
    sums = sums.select(*keys, "_part", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"), F.sum("_m").over(Window.partitionBy(*keys)).alias("n"))
    running = F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    ranked = dealt.withColumn("_run", running).join(sums, [*keys, "_part"]).withColumn("_hi", F.col("_before") + F.col("_run"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_hi") - F.col("_c")) & (rank < F.col("_hi")), F.col(column)))

    place = lambda q: (F.col("n") - 1) * q
    found = ranked.groupBy(*keys, "n").agg(*[c.alias(f"_{s}{k}") for k, q in enumerate(shares) for s, c in (("l", at(F.floor(place(q)))), ("h", at(F.ceil(place(q)))))])
    each = [F.col(f"_l{k}") + (F.col(f"_h{k}") - F.col(f"_l{k}")) * (place(q) - F.floor(place(q))) for k, q in enumerate(shares)]
    return found.select(*by, "n", F.array(*each).alias("q"))


def unitscale(values: DataFrame, column: str, q0: float, q1: float, by: list[str]) -> DataFrame:
    """Column rescaled so that its quantiles q0 and q1 become 0 and 1, clipped."""
    if (q0, q1) == (0.0, 1.0):
        pair = F.array(F.min(column), F.max(column)).alias("_q")
        ends = values.groupBy(*by).agg(pair) if by else values.agg(pair)
    else:
        ends = quantiles(values, column, [q0, q1], by).select(*by, F.col("q").alias("_q"))
    joined = values.join(ends, by) if by else values.crossJoin(F.broadcast(ends))
    return joined.withColumn(column, rescaled(F.col(column), F.col("_q")[0], F.col("_q")[1])).drop("_q")


def rgb_mix(densities: DataFrame, columns: list[str], colours: list[tuple[float, float, float]], by: list[str]) -> DataFrame:
    """Unit-scaled densities as one colour a bin: r, g, b are weighted sums clipped at 1."""
    out = densities
    for c in columns:
        out = unitscale(out, c, 0.0, 1.0, by)
    mix = [F.least(sum((F.col(c) * w[k] for c, w in zip(columns, colours)), F.lit(0.0)), F.lit(1.0)).alias(n) for k, n in enumerate("rgb")]
    return out.select(*by, "iy", "ix", *mix)
