"""Recordings as tables: contract checks, unit conversion, fitted-parameter stores, directories."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.binning import shared_counts, spike_counts
from tessera.operators.series import patch_glitches
from tessera.runtime import cut

SAMPLES = {"cell_id", "t", "x_px", "y_px"}
SPIKES = {"cell_id", "spike_sample"}
RECORDINGS = {"cell_id", "pos_rate", "px_per_m", "spk_rate"}


def require(df: DataFrame, columns: set[str], name: str) -> DataFrame:
    gone = sorted(columns - set(df.columns))
    if gone:
        raise ValueError(f"{name} lacks {', '.join(gone)}")
    return df


def silent(spikes: DataFrame, recordings: DataFrame) -> DataFrame:
    """Keys of recordings that have no spikes (worth a warning)."""
    return recordings.select("cell_id").distinct().join(spikes.select("cell_id"), "cell_id", "left_anti")


def remapped(degrees):
    """Head direction of the earlier convention: (180 - degrees) modulo 360."""
    return F.pmod(180 - degrees, F.lit(360.0))


def track(samples: DataFrame, spikes: DataFrame, recordings: DataFrame, patch: bool = True, warn: bool = False) -> DataFrame:
    """cell_id, t, x, y (metres), s: positions in metres with event counts per sample, jumps patched.

    Event samples are converted to position samples by the two rates and shared between neighbours as in `spike_counts`
    (mass at the closed upper edge goes to the last sample); the glitch threshold is each recording's own sample time.
    `recordings` has one row a key and `t` counts from 0.  `warn`: a warning names how many recordings have no spikes.
    """
    require(samples, SAMPLES, "samples")
    require(spikes, SPIKES, "spikes")
    require(recordings, RECORDINGS, "recordings")
    if warn and (n := silent(spikes, recordings).count()):
        warnings.warn(f"{n} recordings have no spikes", stacklevel=2)
    keys = recordings.select(*sorted(RECORDINGS))
    place = samples.join(keys, "cell_id").select(
        "cell_id", "t", (F.col("x_px") / F.col("px_per_m")).alias("x"), (F.col("y_px") / F.col("px_per_m")).alias("y"), (1 / F.col("pos_rate")).alias("_dt")
    )
    steps = samples.groupBy("cell_id").agg((F.max("t") + 1).alias("steps"))
    times = spikes.join(keys, "cell_id").join(steps, "cell_id").select("cell_id", "steps", (F.col("spike_sample") / F.col("spk_rate") * F.col("pos_rate")).alias("u"))
    count = shared_counts(times, F.col("u"), F.col("steps"), ["cell_id"]).withColumnRenamed("count", "s")
    out = place.join(count, ["cell_id", "t"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    if patch:
        holes = out.withColumn("x", F.when(~F.isnan("x"), F.col("x"))).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
        out = patch_glitches(holes, F.col("_dt"))
    return out.select("cell_id", "t", "x", "y", "s")


def read(spark: SparkSession, path: str, prefix: str = "", suffix: str = "") -> DataFrame:
    """Parquet files of a directory with their file name as `source_file`, filtered by name."""
    rows = spark.read.parquet(path).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.where(F.col("source_file").startswith(prefix) & F.col("source_file").endswith(suffix))


def shuffled(rows: DataFrame, by: list[str], seed: int = 0) -> DataFrame:
    """Rows in an order that depends on their keys and the seed alone."""
    return rows.orderBy(F.xxhash64(*by, F.lit(seed)), *by)


def missing(keys: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    """Keys that `done` lacks."""
    return keys.join(done.select(*by), by, "left_anti")


def _stored(spark: SparkSession, store: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(store)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load(spark: SparkSession, store: str) -> DataFrame:
    """Rows of a store of fits."""
    return spark.read.parquet(store).drop(BUCKET)


def pending(keys: DataFrame, spark: SparkSession, store: str, by: list[str]) -> DataFrame:
    """Keys without a row in the store (a Parquet folder of fits, which may not exist yet)."""
    return missing(keys, load(spark, store), by) if _stored(spark, store) else keys


BUCKET = "_bucket"


def save(fits: DataFrame, store: str, by: list[str] = ["cell_id"], buckets: int = 64) -> None:  # noqa: B006
    """Put fits into a store in place of what it holds for their keys, so a job that runs again changes nothing.

    Rows lie in folders by a hash of their key; folders that get rows are written anew, with their rows of other keys, in
    one job that changes nothing unless it succeeds.  `buckets` must stay the same over a store's life."""
    spark = fits.sparkSession
    dealt = lambda df: df.withColumn(BUCKET, F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
    rows = cut(dealt(fits))  # computed before the store changes, as it may have been read for them
    if _stored(spark, store):
        touched = rows.select(BUCKET).distinct()  # at most `buckets` rows
        old = spark.read.parquet(store).join(F.broadcast(touched), BUCKET).join(rows.select(*by).distinct(), by, "left_anti")
        rows = rows.unionByName(cut(old.select(*rows.columns)))
    rows.repartition(buckets, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(store)


def resume(rows: DataFrame, store: str, compute: Callable[[DataFrame], DataFrame], by: list[str] = ["cell_id"]) -> DataFrame:  # noqa: B006
    """The store after compute(rows of keys that it lacks) has been saved to it: only what is not done yet is computed."""
    spark = rows.sparkSession
    todo = pending(rows, spark, store, by)
    if not todo.isEmpty():
        save(compute(todo), store, by)
    return load(spark, store)


__all__ = ["require", "silent", "remapped", "track", "read", "missing", "pending", "load", "save", "resume", "spike_counts"]
