"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between
(ASCII letters folded, ASCII punctuation and space separate words), and the first
STEM bytes of longer words, as languages with few labelled rows show a word in
many endings, hashed into 2**BITS slots.  Training is one pass after another of per-coordinate FTRL over a
bounded sample of labelled rows (at most MAX_TRAIN, a documented bound,
taken by a hash of doc_id), in one task on an executor; L1 leaves at most a few
thousand weights, which a second fit on those slots alone frees of L1's shrinkage
and which are broadcast.  Scoring is a row-wise map over all whole texts.

Edge cases: a null or empty text scores the bias alone; a null toxic label or
doc_id trains nothing (and is not held out); a label stated twice counts once, repeated
rows each count; texts of any length are read whole; an empty table gives an empty
result; without usable
labels the score is 0.5 for every text; other columns are not read and pass
through under any name, but for `score`, which `score()` replaces or adds under
the name it is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._arrow import map_arrow, map_text, slices
from tessera.llm._store import table
from tessera.llm._text import Words, buffers, mix, span_hashes, text_chunks

BITS = 20
MAX_TRAIN = 12000
PASSES = 4
STEM = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 20.0, 0.0
POSITIVE_WEIGHT = 4.0
THRESHOLD = 0.7

_SPLIT = np.zeros(256, dtype=bool)
_SPLIT[:128] = True
_SPLIT[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def slots(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of every feature occurrence."""
    h = words.hashes(lower=True)
    docs, feats = [words.doc], [h]
    for gap, salt in ((1, 0x5851F42D4C957F2D), (2, 0x14057B7EF767814F)):
        same = words.doc[gap:] == words.doc[:-gap]
        feats.append(mix(h[:-gap] * np.uint64(salt) + h[gap:])[same])
        docs.append(words.doc[:-gap][same])
    long_ = np.flatnonzero(words.ends - words.starts > STEM)
    start = words.starts[long_]
    feats.append(mix(span_hashes(words.raw, start, start + STEM, True) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(STEM)))
    docs.append(words.doc[long_])
    return np.concatenate(docs), (np.concatenate(feats) >> np.uint64(64 - BITS)).astype(np.int64)


def split_words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(raw, offsets, _SPLIT)


class Ftrl:
    """FTRL-proximal for binary features; slot 2**BITS is the bias, which L1 spares."""

    def __init__(self, alpha: float, l1: float, l2: float, size: int = 1 << BITS) -> None:
        self.alpha, self.l1, self.l2 = alpha, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((BETA + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def bias(self) -> float:
        return float(-self.z[-1] / ((BETA + np.sqrt(self.n[-1])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.bias()
        p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
        g = p - label if label == 0 else (p - label) * POSITIVE_WEIGHT
        at, w = np.append(at, len(self.z) - 1), np.append(w, b)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(rows: list[tuple[int, np.ndarray]], passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, bias) of the non-zero weights; rows: (label, distinct slots), in a fixed order."""
    model = Ftrl(ALPHA, L1, L2)
    for _ in range(passes):
        for label, at in rows:
            model.learn(at, label)
    kept = model.weights(slice(0, -1)) != 0
    rows = [(label, at[kept[at]]) for label, at in rows]
    model = Ftrl(ALPHA / 4, 0.0, 1.0)
    for _ in range(passes):
        for label, at in rows:
            model.learn(at, label)
    w = model.weights(slice(0, -1))
    found = np.flatnonzero(w)
    return found, w[found].astype(np.float32), model.bias()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, _ in text_chunks(batch.column("text")):
            part = batch.slice(i, j - i)
            words = split_words(*buffers(part.column("text")))
            doc, slot = slots(words)
            pairs = np.unique(doc << BITS | slot)
            bounds = np.searchsorted(pairs >> BITS, np.arange(j - i + 1))
            low = (pairs & ((1 << BITS) - 1)).astype(np.int32)
            blobs = [low[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([part.column("rank"), part.column("toxic"), pa.array(blobs, pa.binary())], names=["rank", "toxic", "slots"])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        rows += [(r["rank"], r["toxic"], r["slots"]) for r in batch.to_pylist()]
    rows.sort()
    at, w, bias = train([(y, np.frombuffer(s, np.int32)) for _, y, s in rows])
    yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()]), pa.array([w.tobytes()]), pa.array([bias])], names=["slots", "weights", "bias"])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from rows that are not held out: of at most max_train labels (a label stated twice counts once), by a hash of
    doc_id, and of at most max_train rows that they meet, by a hash of the row, whatever the ids."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))
    )
    usable = usable.distinct().withColumn("rank", F.xxhash64("doc_id"))
    sample = usable.orderBy("rank", "doc_id", "toxic").limit(max_train)  # so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("rank", "toxic", "text")
    feats = map_arrow(rows, _extract, "rank long, toxic int, slots binary")
    # learnt in one task; equal rows are alike, so which of them a cut at the bound takes does not matter
    feats = feats.orderBy(F.xxhash64("rank", "toxic", "slots"), "rank", "toxic", "slots").limit(max_train).coalesce(1)
    got = map_arrow(feats, _learn, "slots binary, weights binary, bias double").first()
    if got is None:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0
    return np.frombuffer(got["slots"], np.int32), np.frombuffer(got["weights"], np.float32), got["bias"]


def _score(model: tuple[np.ndarray, np.ndarray, float]):
    def make():
        at, w, bias = model
        dense = np.zeros(1 << BITS, dtype=np.float64)
        dense[at] = w

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            doc, slot = slots(split_words(*buffers(batch.column("text"))))
            hit = np.flatnonzero(dense[slot])
            pairs = np.unique(doc[hit] << BITS | slot[hit])
            total = np.bincount(pairs >> BITS, weights=dense[pairs & ((1 << BITS) - 1)], minlength=len(batch)) + bias
            return {"score": pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))}

        return work

    return make


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], name: str = "score") -> DataFrame:
    """docs plus the probability that the text is toxic, as column `name` (one of that name is replaced)."""

    def make():
        work = _score(model)()
        return lambda batch: {name: work(batch)["score"]}

    return map_text(docs, docs.columns, [T.StructField(name, T.DoubleType())], make)


def _reject(model: tuple[np.ndarray, np.ndarray, float], threshold: float):
    make = _score(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for batch in slices(whole, "text"):
                scores = work(batch)["score"].to_numpy()
                _, offsets = buffers(batch.column("text"))
                yield batch.filter(pa.array((scores < threshold) | (np.diff(offsets) == 0)))

    return run


def reject(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score the threshold or more; null and empty texts stay."""
    return map_arrow(docs, _reject(model, threshold), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
