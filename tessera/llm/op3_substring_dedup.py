"""Substring dedup by relative Lempel-Ziv factors against indexed reference blocks.

The corpus is indexed in reference blocks that together hold every window
(`WINDOW` consecutive words) of it.  The block of a window is chosen by its
anchor, the smallest hash among its ANCHOR-word grams, so windows with equal
words meet in one block and neighbouring windows mostly share one.  Documents are
factored greedily against the blocks: from a window that the index knows from an
earlier place, the factor grows window by window as long as the next ones continue
along the same reference; where it ends, the windows across its border are looked
up themselves, so that factors overlap by up to WINDOW - 1 words and no passage
across a border is missed.  "Earlier" means smaller doc_id, or the same document
and an earlier start; the reference of a factor is the place before it in that
order, so no place is referred to by many.

A factor is a proposal of hashes.  Both texts of it are fetched by their keys and
the words between its boundaries are compared by 128 bits of SHA-256: the reference
side is digested where the reference text is, the other side where the document
is.  Factors that agree remove the words they cover (f windows cover f + WINDOW - 1).
Where they do not agree, hashes collided; all windows on both sides are then
compared one by one, by SHA-256 of their words.  That finds the earlier equal window
if there is one: along references, a window and its first equal either agree all
the way or there is a disagreeing step next to a window of either text.

Volume: a run of windows with one anchor ships as one segment (22-byte head, 6
bytes a window); windows that already have an earlier occurrence in the same
slice of documents are linked there and never shipped, so a passage in a third
of all documents costs one window per 2 MB slice.  Texts are shuffled once.  Lists
grouped by document hold at most two entries a window of it.  Nothing is collected.

Edge cases: a null text has no words; texts shorter than a window lose nothing;
a null doc_id counts as smallest (doc_id is cast to long, what cannot be cast is
null); rows with one doc_id (or none) and equal texts are one document, where only
an earlier start counts, so equal rows keep each other; rows with one doc_id and
unlike texts are documents of their own, in order of a hash of the text; other
columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._arrow import map_arrow, map_text, slices, strings
from tessera.llm._store import shuffle_partitions, table
from tessera.llm._text import _SEP, Words, buffers, gram_starts, grams, mix, text_chunks

WINDOW = 20
ANCHOR = 6
BLOCKS_PER_PARTITION = 8
KEY_BITS = 48
DIGEST = 16
NO_ID = np.iinfo(np.int64).min

LINKS = "doc long, tag int, start int, n int, ref_doc long, ref_tag int, ref_start int"
_LINK_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
_LINK_NAMES = [f.split()[0] for f in LINKS.split(", ")]
SHIPPED = f"block int, segments binary, {LINKS}"


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(doc: np.ndarray, start: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of runs of consecutive starts in one document along which all of `same` are constant."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    for x in same:
        cut |= x[1:] != x[:-1]
    first = np.concatenate([[0], np.flatnonzero(cut) + 1])
    return first, np.diff(np.append(first, len(doc)))


def earlier(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows sorted by (doc, tag, start): index of the window before each one with an equal key at another place, or -1;
    and which windows are the first of their place."""
    n = len(key)
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] != start[:-1])
    order = np.argsort(key, kind="stable")
    k, place = key[order], np.cumsum(fresh)[order]
    step = np.ones(n, dtype=bool)
    step[1:] = (k[1:] != k[:-1]) | (place[1:] != place[:-1])
    before = np.maximum.accumulate(np.where(step, np.arange(n), 0)) - 1
    known = before >= 0
    known[known] = k[before[known]] == k[known]
    out = np.empty(n, dtype=np.int64)
    out[order] = np.where(known, order[before], -1)
    return out, fresh


def factors(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, ref: np.ndarray) -> list[np.ndarray]:
    """Greedy factors (columns of LINKS) of windows sorted by (doc, tag, start), given the index's earlier place of each."""
    at = np.flatnonzero(ref >= 0)
    to = ref[at]
    d, t, s, rd, rt, rs = doc[at], tag[at], start[at], doc[to], tag[to], start[to]
    i, n = runs(d, s, t, rd, rt, s - rs)
    return [d[i], t[i], s[i], n, rd[i], rt[i], rs[i]]


def pack(anchor: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, n: np.ndarray, words: np.ndarray) -> bytes:
    low, high = words.astype(np.uint32), (words >> np.uint64(32)).astype(np.uint16)
    head = np.array([len(anchor), len(words)], dtype=np.uint64)
    columns = (head, (anchor >> np.uint64(32)).astype(np.uint32), doc, tag.astype(np.int32), start.astype(np.uint32), n.astype(np.uint16), low, high)
    return b"".join(x.tobytes() for x in columns)


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    m, total = (int(x) for x in np.frombuffer(blob, np.uint64, 2))
    at, out = 16, []
    for kind, count in ((np.uint32, m), (np.int64, m), (np.int32, m), (np.uint32, m), (np.uint16, m), (np.uint32, total), (np.uint16, total)):
        out.append(np.frombuffer(blob, kind, count, at))
        at += count * np.dtype(kind).itemsize
    anchor, doc, tag, start, n, low, high = out
    return anchor.astype(np.uint64), doc, tag, start.astype(np.int64), n.astype(np.int64), low | (high.astype(np.uint64) << np.uint64(32))


def _links(found: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, _LINK_TYPES)], names=_LINK_NAMES)


def _batch(blocks: list[int], blobs: list, found: list) -> pa.RecordBatch:
    arrays = [pa.array(blocks, pa.int32()), pa.array(blobs, pa.binary()), *(pa.array(x, t) for x, t in zip(found, _LINK_TYPES))]
    return pa.RecordBatch.from_arrays(arrays, names=["block", "segments", *_LINK_NAMES])


def _ship(window: int, blocks: int, key_bits: int):
    """Per slice of documents: its own factors, and the windows without an earlier one in it as segments by block."""
    width, mask = window - ANCHOR + 1, np.uint64((1 << key_bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            for i, j, words in text_chunks(batch.column("text")):
                at = gram_starts(words, window)
                if not len(at):
                    continue
                h = words.hashes()
                key = grams(h, window)[at] & mask
                anchor = window_minimum(grams(h, ANCHOR), width)[at]
                owner = words.doc[at]
                doc, tag, start = ids[i:j][owner], tags[i:j][owner], at - words.first[owner]
                if (np.diff(ids[i:j]) <= 0).any():
                    order = np.lexsort((start, tag, doc))
                    key, anchor, doc, tag, start = key[order], anchor[order], doc[order], tag[order], start[order]
                ref, fresh = earlier(doc, tag, start, key)
                found = factors(doc, tag, start, np.where(fresh, ref, -1))
                if len(found[0]):
                    yield _batch([int(x) for x in mix(found[0].view(np.uint64)) % np.uint64(blocks)], [None] * len(found[0]), found)
                keep = np.flatnonzero((ref < 0) & fresh)
                key, anchor, doc, tag, start = key[keep], anchor[keep], doc[keep], tag[keep], start[keep]
                begin, n = runs(doc, start, tag, anchor, np.arange(len(doc)) // 60000)
                block = (mix(anchor[begin]) % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                bounds = np.flatnonzero(np.diff(block[order], prepend=-1))
                where, blobs = [], []
                for a, b in zip(bounds, np.append(bounds[1:], len(order))):
                    seg = order[a:b]
                    inner = np.repeat(begin[seg] - np.cumsum(n[seg]) + n[seg], n[seg]) + np.arange(n[seg].sum())
                    where.append(int(block[seg[0]]))
                    blobs.append(pack(anchor[begin[seg]], doc[begin[seg]], tag[begin[seg]], start[begin[seg]], n[seg], key[inner]))
                yield _batch(where, blobs, [[None] * len(where)] * len(_LINK_NAMES))

    return run


def _factor_block(blobs: list[bytes]) -> list[np.ndarray]:
    """Factors of the documents that have windows in one reference block."""
    parts = [unpack(b) for b in blobs]
    anchor, doc, tag, start, n, words = (np.concatenate([p[k] for p in parts]) for k in range(6))
    begin = np.cumsum(n) - n
    order = np.lexsort((start, tag, doc))
    m = n[order]
    inner = np.repeat(begin[order] - np.cumsum(m) + m, m) + np.arange(m.sum())
    step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    doc, tag, start = np.repeat(doc[order], m), np.repeat(tag[order], m), np.repeat(start[order], m) + step
    key = mix(words[inner] * np.uint64(0x9E3779B97F4A7C15) ^ np.repeat(anchor[order], m))
    ref, fresh = earlier(doc, tag, start, key)
    return factors(doc, tag, start, np.where(fresh, ref, -1))


def _factor_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by block: one block in memory at a time; factors found before pass through."""
    block, blobs = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if blobs:
            found = _factor_block(blobs)
            blobs.clear()
            if len(found[0]):
                yield _links(found)

    for batch in batches:
        ready = batch.filter(batch.column("segments").is_null()).select(_LINK_NAMES)
        if len(ready):
            yield ready
        batch = batch.filter(batch.column("segments").is_valid())
        for b, blob in zip(batch.column("block").to_pylist(), batch.column("segments")):
            if b != block:
                yield from flush()
                block = b
            blobs.append(blob.as_py())
    yield from flush()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, doc (never null), tag (31 bits of a hash of the text) and text; none of the added columns is nullable, so
    that every join of this table reads one and the same exchange."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID)))
    return docs.select("doc_id", doc.alias("doc"), F.shiftrightunsigned(F.xxhash64("text"), 33).cast("int").alias("tag"), "text")


def proposals(docs: DataFrame, window: int = WINDOW, key_bits: int = KEY_BITS) -> DataFrame:
    """Factors by hashes (LINKS): windows start..start+n-1 of (doc, tag) occur before, at ref_start.. of (ref_doc, ref_tag)."""
    parts = shuffle_partitions(docs.sparkSession)
    blocks = parts * BLOCKS_PER_PARTITION
    shipped = map_arrow(_keyed(docs).select("doc", "tag", "text"), _ship(window, blocks, key_bits), SHIPPED)
    blocked = shipped.repartition(parts, "block").sortWithinPartitions("block")
    return map_arrow(blocked, _factor_blocks, LINKS)


class Joined:
    """Words of consecutive documents joined by single spaces: word w is data[to[w]:end[w]]."""

    def __init__(self, words: Words) -> None:
        self.words = words
        gap = _SEP[words.raw]
        keep = np.ones(len(gap), dtype=bool)
        keep[1:] = ~(gap[1:] & gap[:-1])
        lost = np.cumsum(~keep)
        self.data = np.where(gap, np.uint8(32), words.raw)[keep]
        if len(words):
            self.to, self.end = words.starts - lost[words.starts], words.ends - lost[words.ends - 1]
        else:
            self.to = self.end = np.zeros(0, np.int64)
        self.view = memoryview(self.data)

    def digest(self, a: int, n: int) -> bytes:
        """Of words a..a+n-1."""
        return hashlib.sha256(self.view[int(self.to[a]) : int(self.end[a + n - 1])]).digest()[:DIGEST]


def _entries(column: pa.Array) -> tuple[np.ndarray, dict[str, list]]:
    """(row of each entry, fields of the entries) of a list<struct> column."""
    many = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), many), {f.name: flat.field(k).to_pylist() for k, f in enumerate(flat.type)}


ANSWERS = f"{LINKS}, digest binary"


def _answer(window: int):
    """Over (text, asks): every factor that refers to the text, with the digest of the words it refers to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(*buffers(batch.column("text")))
                joined = Joined(words)
                row, ask = _entries(batch.column("asks"))
                docs, tags = batch.column("doc").to_pylist(), batch.column("tag").to_pylist()
                out: list[tuple] = []
                for k, start, n, doc, tag, at in zip(row.tolist(), ask["ref_start"], ask["n"], ask["doc"], ask["tag"], ask["start"]):
                    if start + n + window - 1 <= words.counts[k]:
                        out.append((doc, tag, at, n, docs[k], tags[k], start, joined.digest(int(words.first[k]) + start, n + window - 1)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), (*_LINK_TYPES, pa.binary()))], names=[*_LINK_NAMES, "digest"])

    return run


def _agreed(joined: Joined, column: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, dict[str, list]]:
    """(row, agreement, fields) of the factors in a list column: whether the words here are those of the reference."""
    words = joined.words
    row, found = _entries(column)
    fine = [
        start + n + window - 1 <= words.counts[k] and joined.digest(int(words.first[k]) + start, n + window - 1) == digest
        for k, start, n, digest in zip(row.tolist(), found["start"], found["n"], found["digest"])
    ]
    return row, np.array(fine, dtype=bool), found


PLACES = "doc long, tag int, start int, n int, digest binary"
_PLACE_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())


def _places(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), _PLACE_TYPES)], names=[f.split()[0] for f in PLACES.split(", ")])


def _doubt(window: int):
    """Over (text, found): of factors that disagree, the digest of every window here, and the windows to fetch there (no digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(*buffers(batch.column("text")))
                joined = Joined(words)
                row, fine, x = _agreed(joined, batch.column("found"), window)
                docs, tags = batch.column("doc").to_pylist(), batch.column("tag").to_pylist()
                out: list[tuple] = []
                for i in np.flatnonzero(~fine).tolist():
                    k, a = int(row[i]), x["start"][i]
                    out.append((x["ref_doc"][i], x["ref_tag"][i], x["ref_start"][i], x["n"][i], None))
                    for s in range(a, min(a + x["n"][i], int(words.counts[k]) - window + 1)):
                        out.append((docs[k], tags[k], s, 1, joined.digest(int(words.first[k]) + s, window)))
                if out:
                    yield _places(out)

    return run


def _fetch(window: int):
    """Over (text, asks): the digest of every window asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(*buffers(batch.column("text")))
                joined = Joined(words)
                row, ask = _entries(batch.column("asks"))
                docs, tags = batch.column("doc").to_pylist(), batch.column("tag").to_pylist()
                out = [
                    (docs[k], tags[k], s, 1, joined.digest(int(words.first[k]) + s, window))
                    for k, a, n in zip(row.tolist(), ask["start"], ask["n"])
                    for s in range(a, min(a + n, int(words.counts[k]) - window + 1))
                ]
                if out:
                    yield _places(out)

    return run


FACTOR = T.StructType(
    [T.StructField("start", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("ref_doc", T.LongType()), T.StructField("ref_start", T.IntegerType())]
)
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("kept_text", T.StringType()),
    T.StructField("factors", T.ArrayType(FACTOR)),
]


def _apply(window: int):
    """Over (text, found, more): words that no agreed factor and no single window of `more` covers."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        words = Words(*buffers(batch.column("text")))
        joined = Joined(words)
        row, fine, x = _agreed(joined, batch.column("found"), window)
        drop = np.zeros(len(words) + 1, dtype=np.int32)
        spans: list[list[dict]] = [[] for _ in range(len(batch))]
        for i in np.flatnonzero(fine).tolist():
            k, a, n = int(row[i]), x["start"][i], x["n"][i] + window - 1
            drop[words.first[k] + a] += 1
            drop[words.first[k] + a + n] -= 1
            ref = x["ref_doc"][i]
            spans[k].append({"start": a, "words": n, "ref_doc": None if ref == NO_ID else ref, "ref_start": x["ref_start"][i]})
        for k, more in enumerate(batch.column("more").to_pylist()):
            for a in more or []:
                if a + window <= words.counts[k]:
                    drop[words.first[k] + a] += 1
                    drop[words.first[k] + a + window] -= 1
        gone = np.cumsum(drop[:-1]) > 0
        kept = np.flatnonzero(~gone)
        owner = words.doc[kept]
        again = np.zeros(len(kept), dtype=bool)
        again[:-1] = owner[1:] == owner[:-1]
        mark = np.zeros(len(joined.data) + 1, dtype=np.int8)
        mark[joined.to[kept]] += 1
        mark[joined.end[kept]] -= 1
        here = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
        here[joined.end[kept[again]]] = True  # the space after a kept word that another follows
        rows = len(batch)
        length = np.bincount(owner, weights=joined.end[kept] - joined.to[kept] + again, minlength=rows).astype(np.int64)
        return {
            "n_words": pa.array(words.counts.astype(np.int64)),
            "n_removed": pa.array(np.bincount(words.doc[gone], minlength=rows).astype(np.int64)),
            "kept_text": strings(joined.data[here].tobytes(), length),
            "factors": pa.array(
                [sorted(f, key=lambda y: y["start"]) for f in spans],
                pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())])),
            ),
        }

    return work


def dedup_substrings(docs: DataFrame, window: int = WINDOW, key_bits: int = KEY_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by spaces) and factors (the duplicate spans, in words).

    `key_bits`: bits of the window hashes; any number gives the same result, fewer mean more factors to doubt.
    """
    texts = _keyed(docs)
    all_ = ["doc_id", "doc", "tag", "text"]
    own = lambda *fields: F.collect_set(F.struct(*fields))
    asks = proposals(docs, window, key_bits).groupBy(F.col("ref_doc").alias("doc_"), F.col("ref_tag").alias("tag_")).agg(own("ref_start", "n", "doc", "tag", "start").alias("asks"))
    asks = asks.select(F.col("doc_").alias("doc"), F.col("tag_").alias("tag"), "asks")
    answers = map_arrow(texts.join(asks, ["doc", "tag"]).select(*all_, "asks"), _answer(window), ANSWERS)
    found = answers.groupBy("doc", "tag").agg(own("start", "n", "ref_doc", "ref_tag", "ref_start", "digest").alias("found"))

    doubted = map_arrow(texts.join(found, ["doc", "tag"]).select(*all_, "found"), _doubt(window), PLACES)
    there = doubted.where("digest is null").groupBy("doc", "tag").agg(own("start", "n").alias("asks"))
    fetched = map_arrow(texts.join(there, ["doc", "tag"]).select(*all_, "asks"), _fetch(window), PLACES)
    places = doubted.where("digest is not null").unionByName(fetched).select(F.struct("doc", "tag", "start").alias("place"), "digest").distinct()
    first = places.groupBy("digest").agg(F.min("place").alias("first"))
    again = places.join(first, "digest").where(F.col("place") > F.col("first"))
    more = again.groupBy(F.col("place.doc").alias("doc"), F.col("place.tag").alias("tag")).agg(F.collect_set("place.start").alias("more"))

    met = texts.join(found, ["doc", "tag"], "left").join(more, ["doc", "tag"], "left").select(*all_, "found", "more")
    return map_text(met, ["doc_id"], FIELDS, lambda: _apply(window), read=("doc", "tag", "found", "more"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH split_ AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
word_ AS (SELECT doc_id, generate_subscripts(a, 1) AS p, unnest(a) AS word, a FROM split_),
window_ AS (SELECT doc_id, p, word, CASE WHEN p + {WINDOW - 1} <= len(a) THEN array_to_string(a[p:p + {WINDOW - 1}], ' ') END AS win FROM word_),
first_ AS (SELECT doc_id, p, word, win IS NOT NULL AND rank() OVER (PARTITION BY win ORDER BY doc_id, p) > 1 AS dup FROM window_),
cover_ AS (SELECT doc_id, p, word, max(dup::INT) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) = 1 AS gone FROM first_),
sum_ AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM cover_ GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN sum_ USING (doc_id)"""
