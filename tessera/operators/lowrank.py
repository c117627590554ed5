"""Posteriors of fits as tables of retained frequencies, and what follows from them without fitting again.

A posterior is rows (key, shape, r, place, weight, factor): the r-th retained frequency's
flat place in the grid of `shape`, its mean weight, and column r of the factor C with C'C
the covariance of the weights.  Moments at any points and draws meet these rows by key;
sample ranges and points of one key are dealt to many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import solver
from tessera.operators import fits
from tessera.operators.fits import _key, _maps, _run, _spectrum
from tessera.runtime import ship

BY = ["cell_id"]
ROWS = "shape array<int>, r int, place int, weight double, factor array<double>"


def _rows(row: pd.Series, got: solver.Fit, by: list[str]) -> pd.DataFrame:
    size = len(got.u)
    out = {x: [row[x]] * size for x in by} | {"shape": [list(got.kept.shape)] * size, "r": range(size), "place": got.waves.places}
    return pd.DataFrame(out | {"weight": got.u, "factor": list(got.factor.T)})


def posterior(packed: DataFrame, style: str = "radial", by: list[str] = BY) -> DataFrame:
    """Posterior rows of `fits.fit_maps`' fits: of the log rate less the prior mean."""

    def one(row: pd.Series) -> pd.DataFrame:
        n, k = _maps(row)
        spectrum, mean, _ = _spectrum(n, k, row.get("period"), row.get("variance"), row.get("angle"), style)
        return _rows(row, solver.fit(spectrum, n, k, mean), by)

    return _run(packed, one, f"{_key(packed, by)}, {ROWS}", by)


def heading_posterior(packed: DataFrame, style: str = "radial", by: list[str] = BY, keep: int = 1000) -> DataFrame:
    """Posterior rows of `fits.fit_headings`' joint fits; shape is layers, height, width."""
    return _run(packed, lambda row: _rows(row, fits._joint(row, style, keep), by), f"{_key(packed, by)}, {ROWS}", by)


def assembled(rows: DataFrame, by: list[str] = BY) -> DataFrame:
    """One row a key: shape and arrays places, weights and factor (its columns one after the other), of at most the solver's
    limit of frequencies squared."""
    parts = F.array_sort(F.collect_list(F.struct("r", "place", "weight", "factor")))
    whole = rows.groupBy(*by).agg(F.first("shape").alias("shape"), parts.alias("_p"))
    return whole.select(*by, "shape", F.col("_p.place").alias("places"), F.col("_p.weight").alias("weights"), F.flatten("_p.factor").alias("factor"))


def _waves(shape, places) -> solver.Waves:
    kept = np.zeros(int(np.prod(shape)), dtype=bool)
    kept[np.asarray(places, dtype=np.int64)] = True  # whole numbers, which pandas holds as floats beside nulls
    return solver.Waves(kept.reshape(tuple(int(s) for s in shape)))


def stream(seed: int, key: tuple, sample: int) -> np.random.Generator:
    """The random stream of one sample: a counter-based generator keyed by the seed and a CRC of the key, that starts at the
    sample's own counter."""
    name = zlib.crc32(repr(tuple(x.item() if hasattr(x, "item") else x for x in key)).encode())
    return np.random.Generator(np.random.Philox(key=np.array([seed & (2**64 - 1), name], np.uint64), counter=sample << 128))


def draws(rows: DataFrame, count: int, seed: int = 0, by: list[str] = BY, block: int = 64) -> DataFrame:
    """(key, sample_id, shape, z): `count` draws a key.  A draw depends on seed, key and sample alone; `block` of them are one
    task's share, so those of one key spread over tasks."""
    blocks = -(-count // block)
    dealt = assembled(rows, by).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def one(row: pd.Series) -> pd.DataFrame:
        waves, size = _waves(row["shape"], row["places"]), len(row["weights"])
        factor = np.asarray(row["factor"], dtype=float).reshape(size, size).T
        ids = list(range(row["_block"] * block, min(count, (row["_block"] + 1) * block)))
        noise = np.stack([stream(seed, tuple(row[x] for x in by), i).standard_normal(size) for i in ids])
        z = waves.field(np.asarray(row["weights"]) + noise @ factor)
        return pd.DataFrame({x: [row[x]] * len(ids) for x in by} | {"sample_id": ids, "shape": [row["shape"]] * len(ids), "z": [d.ravel() for d in z]})

    return _run(dealt, one, f"{_key(rows, by)}, sample_id long, shape array<int>, z array<double>", [*by, "_block"])


def moments_at(rows: DataFrame, points: DataFrame, by: list[str] = BY, spread: int | None = None) -> DataFrame:
    """points(key, point_id, at[, to]) with mean and variance of the log rate less the prior mean at `at`, an array of bin
    coordinates (which may lie between bins), and with the covariance between `at` and `to`.

    Rows of a posterior and points meet in tasks by (key, part): the posterior's rows come first, then points batch by
    batch, so a task holds one posterior and one batch.  Points of a key are dealt to `spread` parts, each of which gets the
    posterior; by default as many as give two parts a task.  Points of keys without a posterior are left out."""
    spark = rows.sparkSession
    ship(spark)
    shuffle = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if spread is None:
        spread = max(1, -(-2 * shuffle // max(1, rows.select(*by).distinct().count())))
    pair = "to" in points.columns
    own = points.select(*by, "point_id", F.col("at").cast("array<double>").alias("at"), *([F.col("to").cast("array<double>").alias("to")] if pair else []))
    own = own.withColumn("_part", F.pmod(F.xxhash64("point_id", "at"), F.lit(spread)).cast("int")).withColumn("_kind", F.lit(1))
    laid = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).withColumn("_kind", F.lit(0))
    met = laid.unionByName(own, allowMissingColumns=True).repartition(shuffle, *by, "_part").sortWithinPartitions(*by, "_part", "_kind", "r")

    def run(batches: Iterable[pd.DataFrame]):
        now, held, ready = None, [], None
        for batch in batches:
            for group, part in batch.groupby([*by, "_part"], sort=False, dropna=False):
                if group != now:
                    now, held, ready = group, [], None
                first = part[part["_kind"] == 0]
                held += first[["shape", "place", "weight", "factor"]].to_records(index=False).tolist()
                asked = part[part["_kind"] == 1]
                if not len(asked) or not held:
                    continue
                if ready is None:
                    ready = _waves(held[0][0], [x[1] for x in held]), np.array([x[2] for x in held]), np.stack([x[3] for x in held], axis=1)
                waves, weights, factor = ready
                f = waves.at(np.stack(asked["at"]))
                cf = factor @ f
                out = {x: asked[x] for x in [*by, "point_id"]} | {"mean": weights @ f, "variance": (cf * cf).sum(axis=0)}
                if pair:
                    out["covariance"] = (cf * (factor @ waves.at(np.stack(asked["to"])))).sum(axis=0)
                yield pd.DataFrame(out)

    kind = points.schema["point_id"].dataType.simpleString()
    return met.mapInPandas(run, f"{_key(rows, by)}, point_id {kind}, mean double, variance double{', covariance double' if pair else ''}")
