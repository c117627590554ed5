"""Benchmark decontamination: BM25 inverted index of test items, block-max WAND.

Test items are indexed (words of folded ASCII letters and digits; bytes over 127
are letters).  Impacts are BM25 weights divided by the item's score against its
own words, so a score is the share of an item's weight that a passage holds.
Every text is cut into overlapping passages (two steps of at least STEP words,
one step apart, so that each item fits whole into some passage) and every
passage queries the index: first the block maxima of its terms are summed for
all blocks at once, then passages with a block that can reach the threshold go
through block-max WAND, which returns every item at or above it.  A hit counts
only if enough word pairs of the item's question and of its answer (its last
sentence, or last third) are in the passage.

The index is broadcast.  Its parts are bounded: postings and word pairs by the
INDEX_BYTES of text in a slice (some 24 bytes a posting, 8 a pair), block maxima
by BOUND_BYTES, as more terms are summed up over fewer, wider blocks.  A larger
benchmark is searched slice by slice, with document frequencies, item count,
lengths and passages of the whole.  Documents are neither shuffled nor cut.

Edge cases: null or empty texts and items never match; items with one id are
searched separately; repeated rows give repeated hits; null doc_ids pass
through; of several passages of one text that match an item the best (then
first) is given; doc_id is cast to long in `leaks` (what cannot be cast is null);
other columns are not read and pass through `decontaminate` under any name; empty
tables give no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._arrow import map_arrow, slices
from tessera.llm._store import cut, table
from tessera.llm._text import buffers, grams
from tessera.llm.op5_toxicity import split_words

K1, B = 1.2, 0.75
THRESHOLD = 0.5
QUESTION, ANSWER = 0.5, 0.4
STEP = 64
BLOCK = 2
COLUMNS = 128
SUMMED = 1024
INDEX_BYTES = 16 << 20
BOUND_BYTES = 64 << 20


def answer_start(text: str, n_words: int) -> int:
    """Index of the first word of the answer: the last sentence if it follows another and has four words, else the last third."""
    ends = [m.end() for m in re.finditer(r"[.!?](?=\s)", text.rstrip())]
    for end in reversed(ends):
        tail = np.frombuffer(text[end:].encode(), np.uint8)
        words = len(split_words(tail, np.array([0, len(tail)])))
        if 4 <= words < n_words:
            return n_words - words
    return n_words - max(1, n_words // 3)


class Whole(NamedTuple):
    """Of the whole benchmark: sorted terms of a slice and their document frequencies, items, their words, longest item."""

    vocab: np.ndarray
    df: np.ndarray
    items: int
    words: int
    longest: int


class Index:
    """Inverted index with block maxima over test items."""

    def __init__(self, items: list[tuple[int, str]], block: int = BLOCK, whole: Whole | None = None) -> None:
        self.block = block
        items = [(i, t) for i, t in items if t]
        words = split_words(*buffers(pa.array([t for _, t in items], pa.string())))
        used = np.flatnonzero(words.counts)
        h = words.hashes(lower=True)
        self.ids = [items[k][0] for k in used]
        self.longest = whole.longest if whole else int(words.counts.max(initial=0))
        item = np.searchsorted(used, words.doc)
        self.vocab, term = np.unique(h, return_inverse=True)
        v, n = len(self.vocab), len(used)
        pairs, tf = np.unique(term * max(n, 1) + item, return_counts=True)
        self.term, self.item = (pairs // max(n, 1)).astype(np.int32), (pairs % max(n, 1)).astype(np.int32)
        df, total = np.bincount(self.term, minlength=v), n
        length = words.counts[used].astype(float)
        mean = length.mean() if n else 1
        if whole:
            df, total, mean = whole.df[np.searchsorted(whole.vocab, self.vocab)], whole.items, whole.words / max(whole.items, 1)
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(mean, 1))
        weight = idf[self.term] * tf * (K1 + 1) / (tf + norm[self.item])
        own = np.bincount(self.item, weights=weight, minlength=n)
        self.impact = weight / own[self.item]
        self.first = np.searchsorted(self.term, np.arange(v + 1))
        self.top = np.maximum.reduceat(self.impact, self.first[:-1]) if v else np.zeros(0)
        blocks = max(1, -(-n // block))
        self.columns = max(1, min(COLUMNS, blocks, BOUND_BYTES // (4 * max(v, 1))))
        column = self.item.astype(np.int64) // block * self.columns // blocks
        self.bounds = np.zeros((v, self.columns), dtype=np.float32)
        np.maximum.at(self.bounds, (self.term, column), np.nextafter(self.impact.astype(np.float32), np.float32(2)))
        self.question, self.answer = [], []
        for k in used:
            a, b = words.first[k], words.first[k + 1]
            cut = answer_start(items[k][1], int(b - a))
            pair = grams(h[a:b], 2)
            self.question.append(np.unique(pair[: max(cut - 1, 0)]))
            self.answer.append(np.unique(pair[min(cut, max(len(pair) - 1, 0)) :]))
        self._lists: dict[int, tuple] = {}

    def _list(self, t: int) -> tuple[list, list, dict, float]:
        """Items, impacts, block maxima and maximum of a term."""
        if t not in self._lists:
            a, b = self.first[t], self.first[t + 1]
            items, impacts = self.item[a:b].tolist(), self.impact[a:b].tolist()
            tops: dict[int, float] = {}
            for i, x in zip(items, impacts):
                tops[i // self.block] = max(tops.get(i // self.block, 0.0), x)
            self._lists[t] = (items, impacts, tops, float(self.top[t]))
        return self._lists[t]

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of every item that scores threshold or more for the distinct terms."""
        threshold -= 1e-9
        live = [[*self._list(t), 0] for t in terms]
        found = []

        def seek(lists: list, item: int) -> None:
            for x in lists:
                items, at = x[0], x[4]
                while at < len(items) and items[at] < item:
                    at += 1
                x[4] = at

        while live:
            live.sort(key=lambda x: x[0][x[4]])
            bound, pivot = 0.0, -1
            for k, x in enumerate(live):
                bound += x[3]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = live[pivot][0][live[pivot][4]]
            while pivot + 1 < len(live) and live[pivot + 1][0][live[pivot + 1][4]] == item:
                pivot += 1
            head, block = live[: pivot + 1], item // self.block
            if sum(x[2].get(block, 0.0) for x in head) < threshold:
                stop = (block + 1) * self.block
                if pivot + 1 < len(live):
                    stop = min(stop, live[pivot + 1][0][live[pivot + 1][4]])
                seek(head, stop)
            elif live[0][0][live[0][4]] == item:
                score = sum(x[1][x[4]] for x in head)
                if score >= threshold:
                    found.append((item, score))
                seek(head, item + 1)
            else:
                seek(head, item)
            live = [x for x in live if x[4] < len(x[0])]
        return found

    def candidates(self, where: np.ndarray, term: np.ndarray, threshold: float) -> Iterator[tuple[int, list[int]]]:
        """(passage, its terms) of passages in which some block's maxima sum to the threshold; input sorted by passage."""
        new = np.flatnonzero(np.diff(where, prepend=-1))
        ends = np.append(new[1:], len(where))
        for a in range(0, len(new), SUMMED):
            b = min(a + SUMMED, len(new))
            lo, hi = new[a], ends[b - 1]
            sums = np.add.reduceat(self.bounds[term[lo:hi]], new[a:b] - lo, axis=0)
            for k in (np.flatnonzero(sums.max(axis=1) >= threshold - 1e-4) + a).tolist():
                yield int(where[new[k]]), term[new[k] : ends[k]].tolist()

    def search(self, column: pa.Array, threshold: float = THRESHOLD) -> list[tuple[int, int, int, float, float, float]]:
        """(row, item, first word of the passage, score, question overlap, answer overlap) of verified hits."""
        words = split_words(*buffers(column))
        v = len(self.vocab)
        if not len(words) or not v:
            return []
        step = max(STEP, self.longest)
        h = words.hashes(lower=True)
        t = np.minimum(np.searchsorted(self.vocab, h), v - 1)
        known = np.flatnonzero(self.vocab[t] == h)
        if not len(known):
            return []
        per = -(-words.counts // step)
        base = np.cumsum(per) - per
        at = np.arange(len(words)) - words.first[words.doc]
        piece = base[words.doc] + at // step
        row = np.repeat(np.arange(len(per)), per)
        joined = np.append(row[1:] == row[:-1], False)
        own = np.unique(piece[known] * v + t[known])
        before = own // v - 1
        also = own[(before >= 0) & joined[before]] - v
        pairs = np.unique(np.concatenate([own, also]))
        where, term = pairs // v, pairs % v
        pair = grams(h, 2)
        best: dict[tuple[int, int], tuple] = {}
        for w, terms in self.candidates(where, term, threshold):
            found = self.wand(terms, threshold)
            if not found:
                continue
            last = w + 2 if joined[w] else w + 1
            r = int(row[w])
            a = int(words.first[r] + (w - base[r]) * step)
            b = int(min(a + (last - w) * step, words.first[r + 1]))
            here = np.unique(pair[a : b - 1])
            for item, score in found:
                q, s = (float(np.isin(x, here).mean()) if len(x) else 1.0 for x in (self.question[item], self.answer[item]))
                if q >= QUESTION and s >= ANSWER and score > best.get((r, item), (0, 0))[1]:
                    best[r, item] = (a - int(words.first[r]), score, q, s)
        return [(r, i, *rest) for (r, i), rest in best.items()]


TERMS = "term long, n long, words long, longest long"


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items that hold each term; under the null term all items with words, their words and the longest."""
    for whole in batches:
        for batch in slices(whole, "text"):
            words = split_words(*buffers(batch.column("text")))
            h, term = np.unique(words.hashes(lower=True), return_inverse=True)
            pairs = np.unique(term * max(1, len(batch)) + words.doc)
            df = np.bincount(pairs // max(1, len(batch)), minlength=len(h))
            columns = [h.view(np.int64).tolist() + [None], df.tolist() + [int((words.counts > 0).sum())], [0] * len(h) + [len(words)], [0] * len(h) + [int(words.counts.max(initial=0))]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=[x.split()[0] for x in TERMS.split(", ")])


def indexes(items: DataFrame, limit: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes over slices of items(item_id, text), each of about `limit` bytes of text at most."""
    rows = items.select("item_id", "text").where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // limit)
    if parts > 1:
        terms = cut(map_arrow(rows, _terms, TERMS).groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("longest").alias("longest")))
        sums = terms.where(F.col("term").isNull()).first()
    for k in range(parts):
        whole = None
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        # bounded: a slice holds about `limit` bytes of test items
        if parts > 1:
            own = map_arrow(part, _terms, TERMS).select("term").distinct()
            found = sorted((r["term"] & (2**64 - 1), r["n"]) for r in terms.join(own, "term", "left_semi").select("term", "n").collect())
            whole = Whole(np.array([x[0] for x in found], np.uint64), np.array([x[1] for x in found], np.int64), sums["n"], sums["words"], sums["longest"])
        yield Index(sorted(((r[0], r[1]) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])), whole=whole)


HITS = "doc_id long, item_id long, start_word long, score double, question_overlap double, answer_overlap double"


def _hits(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = index.search(batch.column("text"))
                if found:
                    ids = batch.column("doc_id").take(pa.array([f[0] for f in found]))
                    rest = [pa.array([index.ids[f[1]] for f in found], pa.int64())] + [pa.array(list(x)) for x in zip(*(f[2:] for f in found))]
                    yield pa.RecordBatch.from_arrays([ids, *rest], names=[x.split()[0] for x in HITS.split(", ")])

    return run


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for every document and test item that it holds: doc_id, item_id, start_word (of the passage), score, overlaps."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in indexes(items):
        found = map_arrow(rows, _hits(index), HITS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], HITS)


def _clean(index: Index, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                keep = np.ones(len(batch), dtype=bool)
                keep[[f[0] for f in index.search(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that hold a test item."""
    for index in indexes(items):
        docs = map_arrow(docs, _clean(index, docs.columns.index("text")), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
