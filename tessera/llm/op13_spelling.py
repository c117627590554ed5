"""Spelling variant grouping over broadcast compact trie shards.

Runs of letters of all texts, A-Z lower-cased, are counted (for some of them one code
point is deleted first, by a hash of document and run); words are the results of at
least `min_chars` code points and `min_count` occurrences.  The words in order, cut
into pieces of at most SHARD_LETTERS letters (a longer word stands alone), become
compact tries: for each node its letter, its first child (children lie side by side)
and the word that ends there.  Tries are built by tasks, and those of up to PASS_BYTES
together are broadcast at once; their number grows with the vocabulary, so every
further PASS_BYTES are one more pass over the words.  In a pass each word's distance-one
Levenshtein automaton is intersected depth-first with every trie: along the word's own
path each node tries an inserted, a replaced and a deleted letter, after which the rest
of the word has to be there as it is.  A word's accepted neighbours are reduced to
their number and the best one (largest count, ties: smallest in code-point order), so a
row for each word leaves a pass; passes are added up by word.

A word's form is its best neighbour if that is `ratio` times as frequent; roots follow
forms by pointer jumping (counts at least double, so the chains end).

Edge cases: a null text has no words; a null doc_id is written as an empty string in
the hash; repeated rows count again; letters are A-Z, a-z and U+00C0 to U+00FF, so a
word has one byte a letter in Latin-1 and byte order is code-point order; very long
texts are read in pieces of PIECE bytes that end between runs, and a run of any length
is one word; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._arrow import map_arrow
from tessera.llm._store import cut, shuffle_partitions, table

MIN_CHARS = 5
MIN_COUNT = 3
RATIO = 2
DELETED = 97
SHARD_LETTERS = 8 << 20
PASS_BYTES = 128 << 20
PIECE = 4 << 20
HELD = 200_000

_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())
#: runs of letters in lower-cased UTF-8; U+00C0 to U+00FF are C3 80 to C3 BF there
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: a byte that is in no run and inside no character
_BETWEEN = re.compile(rb"[\x00-\x60\x7b-\x7f]")


def words_of(doc_id: object, text: str, deleted: int = DELETED, piece: int = PIECE) -> Counter:
    """Counts of a text's words (UTF-8)."""
    raw = text.encode().translate(_FOLD)
    runs: Counter = Counter()
    at = 0
    while at < len(raw):
        stop = _BETWEEN.search(raw, at + piece)
        end = stop.end() if stop else len(raw)
        runs.update(_RUN.findall(raw, at, end))
        at = end
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in runs.items():
        h = crc32(run, start)
        if h % deleted == 0:
            letters = run.decode()
            k = h % len(letters)
            run = (letters[:k] + letters[k + 1 :]).encode()
        out[run] += n
    return out


def _count(deleted: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(map(bytes.decode, held), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                held.update(words_of(doc_id, text.as_py() or "", deleted, piece))
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()

    return run


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, deleted: int = DELETED, piece: int = PIECE) -> DataFrame:
    """(word, n) of the words of docs(doc_id, text) with their occurrences."""
    counted = map_arrow(docs.select("doc_id", "text"), _count(deleted, piece), "word string, n long")
    return counted.where(F.length("word") >= min_chars).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Trie:
    """Compact trie of distinct words (Latin-1) given in order with their counts.

    Nodes are numbered by level, the root 0; letters[i] leads to node i, first[i]:first[i + 1] are node i's children and
    ends[i] is the word that ends there, or -1."""

    def __init__(self, letters: bytes, first: array, ends: array, words: bytes, bounds: array, counts: array) -> None:
        self.letters, self.first, self.ends = letters, first, ends
        self.words, self.bounds, self.counts = words, bounds, counts

    @classmethod
    def build(cls, words: list[bytes], counts: list[int]) -> Trie:
        raw = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        bounds = np.zeros(len(words) + 1, np.int64)
        np.cumsum(lengths, out=bounds[1:])
        node = np.zeros(len(words), np.int64)
        letters, parents = [np.zeros(1, np.uint8)], []
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        nodes, depth, alive = 1, 0, np.flatnonzero(lengths > 0)
        while len(alive):
            above, letter = node[alive], raw[bounds[alive] + depth]
            new = np.ones(len(alive), bool)
            new[1:] = (above[1:] != above[:-1]) | (letter[1:] != letter[:-1])
            node[alive] = nodes + np.cumsum(new) - 1
            letters.append(letter[new])
            parents.append(above[new])
            nodes += int(new.sum())
            depth += 1
            here = alive[lengths[alive] == depth]
            ended.append((node[here], here))
            alive = alive[lengths[alive] > depth]
        ends = np.full(nodes, -1, np.int32)
        for at, word in ended:
            ends[at] = word
        above = np.concatenate(parents) if parents else np.zeros(0, np.int64)
        first = (np.searchsorted(above, np.arange(nodes + 1)) + 1).astype(np.int32)
        ints = lambda kind, x: array(kind, x.tobytes())
        return cls(np.concatenate(letters).tobytes(), ints("i", first), ints("i", ends), raw.tobytes(), ints("q", bounds), array("q", counts))

    def pack(self) -> list[bytes]:
        return [self.letters, self.first.tobytes(), self.ends.tobytes(), self.words, self.bounds.tobytes(), self.counts.tobytes()]

    @classmethod
    def unpack(cls, parts: list[bytes]) -> Trie:
        return cls(parts[0], array("i", parts[1]), array("i", parts[2]), parts[3], array("q", parts[4]), array("q", parts[5]))

    def word(self, k: int) -> bytes:
        return self.words[self.bounds[k] : self.bounds[k + 1]]

    def near(self, word: bytes) -> set[int]:
        """Words at exactly one inserted, replaced or deleted letter: the automaton's accepting states, depth-first."""
        letters, first, ends, find = self.letters, self.first, self.ends, self.letters.find
        size = len(word)
        found: set[int] = set()

        def rest(node: int, at: int) -> None:
            """No edit is left: the word from `at` on must lead from the node to an end."""
            while at < size:
                node = find(word[at], first[node], first[node + 1])
                if node < 0:
                    return
                at += 1
            if ends[node] >= 0:
                found.add(ends[node])

        node = at = 0
        while True:
            a, b = first[node], first[node + 1]
            if at == size:
                for child in range(a, b):  # one letter more at the end
                    if ends[child] >= 0:
                        found.add(ends[child])
                return found
            own = word[at]
            after = word[at + 1] if at + 1 < size else -1
            if after < 0:
                if ends[node] >= 0:  # the last letter deleted
                    found.add(ends[node])
            elif own != after and (child := find(after, a, b)) >= 0:  # own letter deleted; of equal letters the last one
                rest(child, at + 2)
            for child in range(a, b):
                letter = letters[child]
                if letter == own:
                    continue
                c, d = first[child], first[child + 1]
                if after < 0:  # replaced
                    if ends[child] >= 0:
                        found.add(ends[child])
                elif (next_ := find(after, c, d)) >= 0:
                    rest(next_, at + 2)
                if (next_ := find(own, c, d)) >= 0:  # inserted; of equal letters the last one
                    rest(next_, at + 1)
            node = find(own, a, b)
            if node < 0:
                return found
            at += 1


TRIES = "size long, letters binary, first binary, ends binary, words binary, bounds binary, counts binary"
_FIELDS = [x.split()[0] for x in TRIES.split(", ")]


def _build(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[bytes] = []
        counts: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            parts = Trie.build(words, counts).pack()
            return pa.RecordBatch.from_pylist([dict(zip(_FIELDS, [sum(map(len, parts)), *parts]))], schema=pa.schema([("size", pa.int64()), *((f, pa.binary()) for f in _FIELDS[1:])]))

        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                raw = word.encode("latin-1")
                if words and held + len(raw) > limit:
                    yield flush()
                    words, counts, held = [], [], 0
                words.append(raw)
                counts.append(n)
                held += len(raw)
        if words:
            yield flush()

    return run


def tries(words: DataFrame, shard_letters: int = SHARD_LETTERS) -> DataFrame:
    """Tries of words(word, n) as rows, each over a range of the words in order, with its size in bytes and its number."""
    letters = words.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]
    shards = max(1, -(-letters // shard_letters))
    ordered = words.repartitionByRange(shards, "word").sortWithinPartitions("word")
    return cut(map_arrow(ordered, _build(shard_letters), TRIES).withColumn("shard", F.monotonically_increasing_id()))


def passes(sizes: list[tuple[int, int]], limit: int) -> list[list[int]]:
    """Shards (number, bytes) in groups of at most `limit` bytes; a larger one stands alone."""
    out: list[list[int]] = []
    held = limit + 1
    for shard, size in sizes:
        if held + size > limit:
            out.append([])
            held = 0
        out[-1].append(shard)
        held += size
    return out


NEAR = "word string, n long, n_near long, best_n long, best string"


def _near(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [Trie.unpack(parts) for parts in shipped.value]
        for batch in batches:
            rows = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                raw = word.encode("latin-1")
                total, best = 0, None
                for trie in shards:
                    found = trie.near(raw)
                    if found:
                        total += len(found)
                        counts = trie.counts
                        k = min(found, key=lambda k: (-counts[k], k))
                        if best is None or (-counts[k], trie.word(k)) < best:
                            best = (-counts[k], trie.word(k))
                if best:
                    rows.append((word, n, total, -best[0], best[1].decode("latin-1")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n", "n_near", "best_n", "best"])

    return run


def neighbours(words: DataFrame, shard_letters: int = SHARD_LETTERS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(word, n_near, best_n, best) of words(word, n) that have a near word; words must be cheap to read again (a table)."""
    spark = words.sparkSession
    shards = tries(words, shard_letters)
    found = None
    for group in passes([(r["shard"], r["size"]) for r in shards.select("shard", "size").orderBy("shard").collect()], pass_bytes):
        rows = shards.where(F.col("shard").isin(group)).orderBy("shard").select(*_FIELDS[1:]).collect()  # at most pass_bytes
        shipped = spark.sparkContext.broadcast([[bytes(x) for x in row] for row in rows])
        del rows
        part = cut(map_arrow(words, _near(shipped), NEAR))
        shipped.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("top")
    reduced = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return reduced.select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): the last of the forms from each word on, by pointer jumping."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        met = cut(at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        at = met.select("word", "root")
        if met.where("moved").isEmpty():
            return at


def group(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, deleted: int = DELETED, shard_letters: int = SHARD_LETTERS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs(doc_id, text)."""
    parts = shuffle_partitions(docs.sparkSession)
    words = cut(vocabulary(docs, min_chars, min_count, deleted).repartition(parts))
    near = words.join(neighbours(words, shard_letters, pass_bytes), "word", "left")
    taken = F.col("best_n") >= ratio * F.col("n")
    near = cut(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n")))
    ends = roots(near.where("form is not null").select("word", "form"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))


#: near words share a string with one letter deleted at the same place (replaced), or one is the other with a letter deleted
ORACLE = rf"""
WITH RECURSIVE step_ AS (
  SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS k FROM range(256) AS q(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, k + 1 FROM step_ WHERE k < 8),
table_ AS (SELECT list(v ORDER BY i) AS tb FROM step_ WHERE k = 8),
run_ AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
count_ AS (SELECT doc_id, r, count(*) AS c FROM run_ GROUP BY 1, 2),
hex_ AS (SELECT r, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS h FROM count_),
byte_ AS (SELECT r, c, list_transform(range(0, length(h) // 2), lambda i: (('0x' || h[2 * i + 1:2 * i + 2])::INT)::BIGINT) AS bytes FROM hex_),
crc_ AS (SELECT r, c, xor(list_reduce(bytes, lambda s, x: xor(tb[(xor(s, x) & 255) + 1], s >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM byte_, table_),
made_ AS (SELECT CASE WHEN h % {DELETED} = 0 THEN substring(r, 1, h % length(r)) || substring(r, h % length(r) + 2) ELSE r END AS word, c FROM crc_),
word_ AS (SELECT word, sum(c)::BIGINT AS n FROM made_ WHERE length(word) >= {MIN_CHARS} GROUP BY 1 HAVING sum(c) >= {MIN_COUNT}),
less_ AS (SELECT word, n, p, substring(word, 1, p) || substring(word, p + 2) AS d FROM (SELECT word, n, unnest(range(length(word))) AS p FROM word_)),
near_ AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM less_ a JOIN less_ b ON a.p = b.p AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less_ a JOIN word_ b ON a.d = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less_ a JOIN word_ b ON a.d = b.word),
best_ AS (SELECT word, n, count(*) AS n_near, (arg_min(other, (-m, other))) AS best, max(m) AS m FROM near_ GROUP BY 1, 2),
form_ AS (SELECT word, word_.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= {RATIO} * word_.n THEN best END AS form, CASE WHEN m >= {RATIO} * word_.n THEN m END AS form_n FROM word_ LEFT JOIN best_ USING (word)),
walk_ AS (SELECT word, word AS root, form AS next FROM form_ UNION ALL SELECT walk_.word, walk_.next, form_.form FROM walk_ JOIN form_ ON form_.word = walk_.next)
SELECT form_.word, form, root, n, n_near, form_n FROM form_ JOIN walk_ ON walk_.word = form_.word AND walk_.next IS NULL"""
