"""LM scoring by logistic context mixing over hashed-context bit predictors.

Tokens are the words of a text (A-Z folded) and one end.  Token counts over all
training documents give the base unigram score.  The model codes a token as the
bits of its class on a Huffman tree: tokens with at least 1/MODEL_SHARE of all
occurrences are classes of their own, all others share one class inside which
the unigram holds.  Every bit is predicted from counters in order-0 (exact),
order-1, order-2 and skip contexts (hashed tables, counted over all training
documents); the stretched predictions are mixed with weights that a gate selects
(how well the two longer contexts are known, and the depth of the bit), and an
adaptive probability map refines the result.  Weights and map are learnt on all
training documents: online, bit block after bit block, in groups of about
MIX_DOCS documents (dealt by a hash of the row), each bit left out of its own
counters; then each weight and cell is averaged over the groups, weighted by how
often each group moved it.

The longest context is the phrase: texts are cut where the hash of two tokens
says so (about every PHRASE tokens, so equal passages are cut alike), and every
phrase of the training documents is counted, whole, in a distributed table that
grows with the corpus.  A phrase's probability is the mixture of its share of
all training phrases (itself left out) and of the product of its tokens'
probabilities; the weight is the share of training phrases that occur again.
All factors are proper distributions, so `score` is the log10 probability of the
whole text and total bits per byte follow from it.

What grows with the corpus is kept in tables: counts of all tokens and of all
phrases.  What is broadcast is bounded: tokens with at least 1/LOOKUP_SHARE of
all occurrences (so at most LOOKUP_SHARE), the tree (at most MODEL_SHARE classes)
and the context tables of 2**SLOT_BITS slots an order.  Rare tokens and phrases
meet their counts in shuffle joins that Spark can split.  Tables of tasks are
added up in two levels, so no task reads more than the root of their number.

Edge cases: a null text counts as empty (one end token); a null doc_id is never
held out; doc_id is cast to long (what cannot be cast is null); repeated rows each
count; texts of any length are scored whole; an empty table gives an empty result;
without training tokens every token has probability 1 (scores 0); other
columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._arrow import map_arrow
from tessera.llm._store import cut, shuffle_partitions, table
from tessera.llm._text import _POW_Q, _POW_QI, mix, mix_int, text_chunks

LOOKUP_SHARE = 1 << 20
MODEL_SHARE = 1 << 14
SLOT_BITS = 19
MIX_DOCS = 1500
CHUNK = 1 << 19
BLOCK = 1 << 16
PHRASE = 32
ORDERS = 3
DEPTHS = 4
LEVELS = 5
RATE = 0.01
APM_CELLS = 33
END = mix_int(0x454E44)
RARE = mix_int(0x52415245)
START = mix_int(0x53544152)
_MUL = [mix_int(k) | 1 for k in range(1, 8)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def token_stream(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, tokens, their documents, UTF-8 bytes of each document), chunk by chunk."""
    for i, j, words in text_chunks(column, CHUNK):
        n = j - i
        tokens = np.full(len(words) + n, END, dtype=np.uint64)
        tokens[np.arange(len(words)) + words.doc] = words.hashes(lower=True)
        yield i, j, tokens, np.repeat(np.arange(n), words.counts + 1), np.diff(words.offsets)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, tokens, _, _ in token_stream(batch.column("text")):
            token, n = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])


def phrases(tokens: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase of each token, hash of each phrase): a phrase ends with its document, or at a token whose hash with the one
    before it (in the document) says so."""
    n = len(tokens)
    before = np.full(n, START, dtype=np.uint64)
    before[1:] = np.where(doc[1:] == doc[:-1], tokens[:-1], before[1:])
    last = mix(tokens * np.uint64(_MUL[5]) + before) % np.uint64(PHRASE) == 0
    last[:-1] |= doc[1:] != doc[:-1]
    if n:
        last[-1] = True
    end = np.flatnonzero(last) + 1
    start = np.concatenate([[0], end[:-1]]) if len(end) else end
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(tokens) * _POW_Q.upto(n), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * _POW_QI.upto(n + 1)[start] + (end - start).astype(np.uint64))
    return np.repeat(np.arange(len(end)), end - start), hashes


class Coder:
    """Huffman tree over classes: paths of class k are nodes/bits[first[k]:first[k + 1]]; class 0 is the shared one."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, shared: int) -> None:
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]
        weights = [shared + 0.5, *(self.counts + 0.5).tolist()]
        n = len(weights)
        heap = [(w, k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        up, side, at = np.zeros(2 * n, dtype=np.int64), np.zeros(2 * n, dtype=np.int8), n
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            up[a[1]], up[b[1]], side[b[1]] = at, at, 1
            heapq.heappush(heap, (a[0] + b[0], at))
            at += 1
        root, nodes, bits, sizes = at - 1, [], [], []
        for k in range(n):
            path, x = [], k
            while x != root:
                path.append((int(up[x]) - n, int(side[x])))
                x = int(up[x])
            sizes.append(len(path))
            for node, bit in reversed(path):
                nodes.append(node)
                bits.append(bit)
        self.n_nodes = max(1, n - 1)
        self.nodes, self.bits = np.array(nodes, dtype=np.int64), np.array(bits, dtype=np.int8)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])

    def classes(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(tokens), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, at + 1, 0)


def bit_stream(coder: Coder, tokens: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(classes of tokens; per bit: its token, node, bit, depth; slots of its hashed contexts)."""
    return class_bits(coder, coder.classes(tokens), doc)


def class_bits(coder: Coder, cls: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """bit_stream of classes; contexts are the tokens of classes, RARE for the shared one."""
    known = np.concatenate([np.array([RARE], dtype=np.uint64), coder.tokens])[cls]
    one, two = np.full(len(cls), START, dtype=np.uint64), np.full(len(cls), START, dtype=np.uint64)
    one[1:] = np.where(doc[1:] == doc[:-1], known[:-1], one[1:])
    two[2:] = np.where(doc[2:] == doc[:-2], known[:-2], two[2:])
    contexts = [one * np.uint64(_MUL[0]), mix(one * np.uint64(_MUL[1]) + two), mix(two * np.uint64(_MUL[2]))]
    size = coder.sizes[cls]
    owner = np.repeat(np.arange(len(cls)), size)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    at = coder.first[cls][owner] + step
    node = coder.nodes[at]
    salt = node.astype(np.uint64) * np.uint64(_MUL[3])
    slots = [(((c[owner] ^ salt) * np.uint64(_MUL[4])) >> np.uint64(64 - SLOT_BITS)).view(np.int64) for c in contexts]
    return cls, owner, node, coder.bits[at], np.minimum(step // 3, DEPTHS - 1), slots


def _tables(coder: Coder, groups: int):
    """Counters of one task's documents, order 0 first, in blocks; tasks are dealt to `groups`."""
    size = 2 << SLOT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, hashed = np.zeros(2 * coder.n_nodes, dtype=np.int64), np.zeros((ORDERS, size), dtype=np.int32)
        any_ = False
        for batch in batches:
            for _, _, tokens, doc, _ in token_stream(batch.column("text")):
                _, _, node, bit, _, slots = bit_stream(coder, tokens, doc)
                exact += np.bincount(2 * node + bit, minlength=len(exact))
                for k, s in enumerate(slots):
                    hashed[k] += np.bincount(2 * s + bit, minlength=size).astype(np.int32)
                any_ = True
        if any_:
            flat = np.concatenate([exact.astype(np.int32), hashed.reshape(-1)])
            own = (TaskContext.get().partitionId() if TaskContext.get() else 0) % groups
            for k in range(0, len(flat), BLOCK):
                part = flat[k : k + BLOCK].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([own], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=BLOCKS)

    return run


BLOCKS = ["block", "part", "data"]


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for block, part, data in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), batch.column("data")):
            x = np.frombuffer(data.as_py(), np.int64)
            total[block, part] = total[block, part] + x if (block, part) in total else x
    for (block, part), x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=BLOCKS)


def count_contexts(train: DataFrame, coder: Coder) -> np.ndarray:
    """Counters of all documents of train(text), added up by block within groups of tasks and then over the groups."""
    schema = "block int, part int, data binary"
    parts = shuffle_partitions(train.sparkSession)
    # an upper bound of the number of tasks is not known before the plan runs; the shuffle partitions follow the input as tasks do
    groups = max(1, math.isqrt(parts))
    made = map_arrow(map_arrow(train.select("text"), _tables(coder, groups), schema).repartition(parts, "block", "part"), _add, schema)
    added = map_arrow(made.withColumn("part", F.lit(0)).repartition(parts, "block"), _add, schema)
    # the tables have a fixed size: SLOT_BITS, ORDERS and the tree's nodes
    data = {r["block"]: np.frombuffer(r["data"], np.int64) for r in added.collect()}
    width = 2 * coder.n_nodes + ORDERS * (2 << SLOT_BITS)
    return np.concatenate([data[k] for k in sorted(data)]) if data else np.zeros(width, np.int64)


class Counters:
    """Counts of zeros and ones in order 0 (by node) and in the hashed contexts."""

    def __init__(self, coder: Coder, flat: np.ndarray) -> None:
        cut_ = 2 * coder.n_nodes
        self.pairs = [flat[:cut_].reshape(-1, 2), *flat[cut_:].reshape(ORDERS, -1, 2)]

    @staticmethod
    def stretch(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
        return np.log((ones + 0.4) / (zeros + 0.4))

    def left_out(self) -> list[np.ndarray]:
        """Per order the stretched prediction for slot and bit (at 2 * slot + bit) without one occurrence of that bit there."""
        out = []
        for p in self.pairs:
            without = [Counters.stretch(np.maximum(p[:, 0] - 1, 0), p[:, 1]), Counters.stretch(p[:, 0], np.maximum(p[:, 1] - 1, 0))]
            out.append(np.stack(without, axis=1).reshape(-1).astype(np.float32))
        return out

    @staticmethod
    def level(total: np.ndarray) -> np.ndarray:
        return np.searchsorted([1, 3, 10, 50], total, side="right")


def narrow(flat: np.ndarray) -> np.ndarray:
    """Pairs of counts as int32; a pair beyond 2**30 is halved until it fits, which keeps its ratio."""
    pairs = flat.reshape(-1, 2)
    halvings = np.maximum(0, np.ceil(np.log2(np.maximum(pairs.max(axis=1), 1) / 2.0**30))).astype(np.int64)
    return (pairs >> halvings[:, None]).astype(np.int32).reshape(-1)


class Mixer:
    """Gated weights and the probability map; `p` gives the probability that a bit is one."""

    def __init__(self, weights: np.ndarray | None = None, apm: np.ndarray | None = None) -> None:
        gates = LEVELS * LEVELS * DEPTHS
        self.weights = np.full((gates, ORDERS + 1), 0.3) if weights is None else weights
        cells = 1 / (1 + np.exp(-np.linspace(-8, 8, APM_CELLS)))
        self.apm = np.tile(cells, (DEPTHS, 1)) if apm is None else apm

    @staticmethod
    def gate(level1: np.ndarray, level2: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return (level2 * LEVELS + level1) * DEPTHS + depth

    def _cell(self, dot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (np.clip(dot, -7.999, 7.999) + 8) * ((APM_CELLS - 1) / 16)
        low = x.astype(np.int64)
        return low, x - low

    def p(self, inputs: list[np.ndarray], gate: np.ndarray, depth: np.ndarray) -> np.ndarray:
        dot = sum(self.weights[:, k][gate] * x for k, x in enumerate(inputs))
        low, part = self._cell(dot)
        flat, at = self.apm.reshape(-1), depth * APM_CELLS + low
        refined = flat[at] * (1 - part) + flat[at + 1] * part
        return np.clip(0.5 * (1 / (1 + np.exp(-dot)) + refined), 1e-6, 1 - 1e-6)

    def learn(self, inputs: list[np.ndarray], gate: np.ndarray, depth: np.ndarray, bit: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Online: predict a block of bits, then move weights and map towards what came; how often each gate and cell moved."""
        x = np.stack(inputs, axis=1)
        width = x.shape[1]
        weights, apm = self.weights.reshape(-1), self.apm.reshape(-1)
        place = (gate[:, None] * width + np.arange(width)).reshape(-1)
        row, moved = depth * APM_CELLS, np.zeros(len(apm), dtype=np.int64)
        for a in range(0, len(bit), block):
            b = min(a + block, len(bit))
            xs, y, at = x[a:b], bit[a:b], place[a * width : b * width]
            dot = (weights[at].reshape(-1, width) * xs).sum(axis=1)
            step = (RATE * (y - 1 / (1 + np.exp(-dot))))[:, None] * xs
            weights += np.bincount(at, weights=step.reshape(-1), minlength=len(weights))
            low, part = self._cell(dot)
            near = row[a:b] + low + (part > 0.5)
            apm += np.bincount(near, weights=0.02 * (y - apm[near]), minlength=len(apm))
            moved += np.bincount(near, minlength=len(apm))
        np.clip(self.apm, 1e-5, 1 - 1e-5, out=self.apm)
        return np.bincount(gate, minlength=len(self.weights)), moved


def _classes(coder: Coder):
    """(rank, classes of its tokens as 16-bit numbers) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, tokens, doc, _ in token_stream(batch.column("text")):
                cls = coder.classes(tokens).astype(np.uint16)
                bound = np.searchsorted(doc, np.arange(j - i + 1))
                blobs = [cls[a:b].tobytes() for a, b in zip(bound[:-1], bound[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("rank").slice(i, j - i), pa.array(blobs, pa.binary())], names=["rank", "classes"])

    return run


def _mix(coder: Coder, counters: Counters):
    """Over rows sorted by group: (place among weights and map, value, how often it moved) of every group."""

    stretched, levels = [], []

    def learn(rows: list[tuple]) -> pa.RecordBatch:
        if not stretched:
            stretched.extend(counters.left_out())
            levels.extend(Counters.level(p.sum(axis=1) - 1).astype(np.uint8) for p in counters.pairs[1:3])
        mixer = Mixer()
        gates, cells = np.zeros(len(mixer.weights), dtype=np.int64), np.zeros(mixer.apm.size, dtype=np.int64)
        rows.sort()
        a = 0
        while a < len(rows):
            b, size = a + 1, len(rows[a][1])
            while b < len(rows) and b < a + 50 and size < CHUNK:
                size += len(rows[b][1])
                b += 1
            cls = np.frombuffer(b"".join(x for _, x in rows[a:b]), np.uint16).astype(np.int64)
            doc = np.repeat(np.arange(b - a), [len(x) // 2 for _, x in rows[a:b]])
            a = b
            _, _, node, bit, depth, slots = class_bits(coder, cls, doc)
            inputs = [s[2 * at + bit] for s, at in zip(stretched, [node, *slots])]
            gate = Mixer.gate(levels[0][slots[0]].astype(np.int64), levels[1][slots[1]].astype(np.int64), depth)
            moved = mixer.learn(inputs, gate, depth, bit)
            gates += moved[0]
            cells += moved[1]
        n = np.concatenate([np.repeat(gates, mixer.weights.shape[1]), cells])
        at = np.flatnonzero(n)
        value = np.concatenate([mixer.weights.reshape(-1), mixer.apm.reshape(-1)])
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(value[at]), pa.array(n[at])], names=["place", "value", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            for g, rank, classes in zip(*(batch.column(c).to_pylist() for c in ("group", "rank", "classes"))):
                if g != group and rows:
                    yield learn(rows)
                    rows = []
                group = g
                rows.append((rank, classes))
        if rows:
            yield learn(rows)

    return run


def learn_mixer(train: DataFrame, coder: Coder, counters: Counters) -> tuple[Mixer, int]:
    """Weights and map from all rows of train(doc_id, text), and how many bits they were learnt on; what is shuffled are the
    documents' classes, two bytes a token."""
    mixer = Mixer()
    groups = max(1, -(-train.count() // MIX_DOCS))
    classes = map_arrow(train.select(F.xxhash64("doc_id", "text").alias("rank"), "text"), _classes(coder), "rank long, classes binary")
    dealt = classes.withColumn("group", F.pmod("rank", F.lit(groups)))
    parts = max(groups, shuffle_partitions(train.sparkSession)) if groups > 1 else 1
    learnt = map_arrow(dealt.repartition(parts, "group").sortWithinPartitions("group"), _mix(coder, counters), "place int, value double, n long")
    # decimals, so that sums do not depend on order; at most a row for every weight and cell of the map
    sums = learnt.groupBy("place").agg(F.sum((F.col("value") * F.col("n")).cast("decimal(38, 9)")).alias("x"), F.sum("n").alias("n"))
    flat = np.concatenate([mixer.weights.reshape(-1), mixer.apm.reshape(-1)])
    cut_, bits = mixer.weights.size, 0
    for r in sums.collect():
        flat[r["place"]] = float(r["x"]) / r["n"]
        bits += r["n"] if r["place"] >= cut_ else 0
    return Mixer(flat[:cut_].reshape(mixer.weights.shape), flat[cut_:].reshape(mixer.apm.shape)), bits


ROWS = (
    "row long, doc_id long, held_out boolean, n_bytes long, n_tokens long, known long, log_known double, "
    "phrase array<long>, log_phrase array<double>, rare array<long>, rare_in array<int>"
)


def _score(coder: Coder, lookup: tuple[np.ndarray, np.ndarray], counters: Counters, mixer: Mixer, inside_norm: float):
    """Per document what is known without the rare tokens' counts: sums of log10(c + 0.5) for the base, per phrase its hash and
    log10 of its tokens' probabilities, and the rare tokens with the phrase that each is in."""

    def make() -> tuple:
        stretched = [Counters.stretch(p[:, 0], p[:, 1]).astype(np.float32) for p in counters.pairs]
        levels = [Counters.level(p.sum(axis=1)).astype(np.uint8) for p in counters.pairs[1:3]]
        return stretched, levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretched, levels = make()
        token_of, count_of = lookup
        log_of = np.log10(count_of + 0.5)
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for batch in batches:
            for i, j, tokens, doc, size in token_stream(batch.column("text")):
                n = j - i
                cls, owner, node, bit, depth, slots = bit_stream(coder, tokens, doc)
                inputs = [s[at] for s, at in zip(stretched, [node, *slots])]
                gate = Mixer.gate(levels[0][slots[0]].astype(np.int64), levels[1][slots[1]].astype(np.int64), depth)
                p = mixer.p(inputs, gate, depth)
                if len(token_of):
                    at = np.minimum(np.searchsorted(token_of, tokens), len(token_of) - 1)
                    found = token_of[at] == tokens
                    logs = np.where(found, log_of[at], 0.0)
                else:
                    found, logs = np.zeros(len(tokens), bool), np.zeros(len(tokens))
                phrase, hashes = phrases(tokens, doc)
                inside = cls == 0
                log_phrase = np.bincount(phrase[owner], weights=np.log10(np.where(bit == 1, p, 1 - p)), minlength=len(hashes))
                log_phrase = log_phrase + np.bincount(phrase[inside], weights=logs[inside] - inside_norm, minlength=len(hashes))
                first = np.searchsorted(doc[np.flatnonzero(np.diff(phrase, prepend=-1))], np.arange(n + 1))
                rare = np.flatnonzero(~found)
                bounds = pa.array(np.searchsorted(doc[rare], np.arange(n + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(n)),
                        batch.column("doc_id").slice(i, n),
                        batch.column("held_out").slice(i, n),
                        pa.array(size),
                        pa.array(np.bincount(doc, minlength=n)),
                        pa.array(np.bincount(doc[found], minlength=n)),
                        pa.array(np.bincount(doc, weights=logs, minlength=n), pa.float64()),
                        pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(hashes.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(log_phrase.astype(np.float64))),
                        pa.ListArray.from_arrays(bounds, pa.array(tokens[rare].view(np.int64))),
                        pa.ListArray.from_arrays(bounds, pa.array((phrase[rare] - first[doc[rare]]).astype(np.int32))),
                    ],
                    names=[x.split()[0] for x in ROWS.split(", ")],
                )
                row += n

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, n_phrases and n_repeated (phrases
    that occur elsewhere in the training documents) of docs(doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(F.col("doc_id")))
    train = docs.where(~F.col("held_out"))
    counts = cut(map_arrow(train.select("text"), _count, "token long, n long").groupBy("token").agg(F.sum("n").alias("c")))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    all_tokens, types = int(total[0]), int(total[1])
    # at most LOOKUP_SHARE tokens can hold that share of all occurrences
    top = counts.where(F.col("c") >= -(-all_tokens // LOOKUP_SHARE)).toArrow()
    token, count = top.column("token").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(token)
    token, count = token[order], count[order]
    own = count >= -(-all_tokens // MODEL_SHARE)
    inside = all_tokens - int(count[own].sum())
    coder = Coder(token[own], count[own], inside)
    parts = shuffle_partitions(spark)
    counters = Counters(coder, narrow(count_contexts(train, coder)))
    mixer, _ = learn_mixer(train, coder, counters)
    base_norm = float(np.log10(all_tokens + 0.5 * (types + 1)))
    inside_norm = float(np.log10(inside + 0.5 * (types - int(own.sum())) + 0.5))
    rows = cut(map_arrow(docs, _score(coder, (token, count), counters, mixer, inside_norm), ROWS))

    whole = rows.select("row", "held_out", F.posexplode(F.arrays_zip("phrase", "log_phrase")).alias("k", "x"))
    whole = whole.select("row", "held_out", "k", F.col("x.phrase").alias("phrase"), F.col("x.log_phrase").alias("log"))
    known = whole.where(~F.col("held_out")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    seen = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("again"))
    # counts are dealt anew, so that both sides of the join are exchanges that Spark can split
    met = whole.join(known.repartition(parts, F.xxhash64("phrase")), "phrase", "left").crossJoin(F.broadcast(seen))
    left_out = F.when(F.col("held_out"), 0).otherwise(1)
    others = F.coalesce("n", F.lit(0)) - F.when(F.col("n").isNull(), 0).otherwise(left_out)
    share = F.least(F.col("again") / F.greatest("all_", F.lit(1)), F.lit(0.99))
    repeat = F.when(others > 0, F.log10(share * others / F.greatest(F.col("all_") - left_out, F.lit(1))))
    nothing = F.lit(None).cast("double")
    first = met.select("row", "k", "log", repeat.alias("repeat"), F.log10(1 - share).alias("fresh"), nothing.alias("base"), F.lit(0).alias("hit"))

    rare = rows.select("row", F.explode(F.arrays_zip("rare", "rare_in")).alias("x")).select("row", F.col("x.rare").alias("token"), F.col("x.rare_in").alias("k"))
    log_rare = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    second = rare.join(counts, "token", "left").select(
        "row", "k", log_rare.alias("log"), nothing.alias("repeat"), nothing.alias("fresh"), log_rare.alias("base"), F.when(F.col("c") > 0, 1).otherwise(0).alias("hit")
    )
    # a document's phrases lie in one partition, so both sums need no further exchange
    both = first.unionByName(second).repartition(parts, "row")
    each = both.groupBy("row", "k").agg(F.sum("log").alias("log"), F.max("repeat").alias("repeat"), F.max("fresh").alias("fresh"), F.sum("base").alias("base"), F.sum("hit").alias("hit"))
    plain = F.col("log") + F.col("fresh")
    high, low = F.greatest(plain, F.col("repeat")), F.least(plain, F.col("repeat"))
    mixed = F.when(F.col("repeat").isNull(), plain).otherwise(high + F.log10(F.pow(F.lit(10.0), low - high) + 1))
    sums = each.groupBy("row").agg(
        F.sum(mixed).alias("model"), F.coalesce(F.sum("base"), F.lit(0.0)).alias("log_rare"), F.sum("hit").alias("known_rare"),
        F.count(F.lit(1)).alias("n_phrases"), F.count("repeat").alias("n_repeated"),
    )
    out = rows.drop("phrase", "log_phrase", "rare", "rare_in").join(sums, "row")
    base = F.col("log_known") + F.col("log_rare") - F.col("n_tokens") * base_norm
    model = F.col("model")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("known_rare")).cast("long").alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        model.alias("score"),
        (-model * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
        "n_phrases",
        "n_repeated",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
