"""SentencePiece encoding and decoding: sampling segmentations without replacement.

The pieces of a SentencePiece model span a lattice over a text.  A piece's log
probability falls with its rank as in Zipf's law, log p = -THETA * log(rank + 1)
less the normaliser (a BPE model's scores are ranks, not probabilities), and a
segmentation's probability is the product of its pieces', normalised over the
lattice.  `SAMPLES` distinct segmentations of every whole text are drawn without
replacement by Gumbel top-k as a perturbed A-star search: an entry of the
frontier stands for all paths that leave a drawn path at one node, its key is
the exact maximum of their perturbed log probabilities (a Gumbel of their total
mass, truncated by the maximum of the paths above), so the best entry holds the
next segmentation.  Entries of a drawn path are made together in NumPy, and only
the popped ones are split.  With the key of the (k+1)-th entry as threshold, the
log inclusion score of a segmentation is log(1 - exp(-exp(log p - threshold))).
All draws are hashes of the row's key and their place, so they do not depend on
partitions, order or retries.

Lattices are built per distinct word (spaces and what follows them; a line feed
stands alone), since no piece crosses such borders; a word may be as long as its
text.  Beyond LINEAR bytes to a word's end, masses are kept as logarithms.  Encoding is lossless: characters without a piece,
and U+2581 itself, become byte pieces; decoding drops the leading space that
encoding adds.  The model file (a parameter; else what the session's setting
spark.tessera.pieces names, else MODEL) is read on the driver; its pieces are broadcast.

Edge cases: a null or empty text has one segmentation without pieces (log
probability 0, inclusion 1); a text with fewer segmentations gets them all, each
surely included; repeated rows get equal results; a null key draws as key 0;
doc_id is cast to long (what cannot be cast is null); other columns are not read,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm._arrow import map_arrow
from tessera.llm._store import table
from tessera.llm._text import buffers, chunks, mix, span_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
THETA = 1.0
SEED = 20240607
FAINT = -80.0
LINEAR = 32
CHUNK_BYTES = (1 << 20) - (1 << 15)
_BASE = np.uint64(0x100000001B3 * 2 + 0x9E3779B97F4A7C15)
_TABLE_BITS = 20
_SPREAD = mix(np.arange(101, 117, dtype=np.uint64)) | np.uint64(1)


class Pieces:
    """Vocabulary: bytes (with spaces for U+2581) and log probabilities of pieces, and hash tables to find them."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray, byte_ids: list[int], byte_logp: float) -> None:
        self.pieces, self.logp = pieces, np.asarray(logp, dtype=np.float64)
        self.byte_ids = np.asarray(byte_ids, dtype=np.int32)
        self.byte_logp = byte_logp
        normal = np.array([k for k in range(len(pieces)) if pieces[k] and np.isfinite(self.logp[k])], dtype=np.int32)
        self.longest = max((len(pieces[k]) for k in normal), default=1)
        self.breaks_lines = not any(b"\n" in pieces[k] and len(pieces[k]) > 1 for k in normal)
        # trie over the pieces' bytes: a node is a prefix, found by its hash
        prefixes: dict[int, list] = {}
        for k in normal.tolist():
            h = 0
            for at, c in enumerate(pieces[k]):
                h = (h * int(_BASE) + c + 1) & ((1 << 64) - 1)
                node = prefixes.setdefault(h, [-1, False])
                node[1] |= at + 1 < len(pieces[k])
            node[0] = k
        self.hash = np.array(list(prefixes), dtype=np.uint64)
        self.node_piece = np.array([x[0] for x in prefixes.values()] + [-1], dtype=np.int32)
        self.node_more = np.array([x[1] for x in prefixes.values()] + [False])
        self.tables: list[np.ndarray] = []
        left = np.arange(len(self.hash), dtype=np.int32)
        while len(left):
            slots = np.full(1 << _TABLE_BITS, -1, dtype=np.int32)
            slot = self._slot(self.hash[left], len(self.tables))
            slots[slot] = left
            self.tables.append(slots)
            left = left[slots[slot] != left]
        #: probability of a piece as an edge; the last entry stands for no edge
        self.weight = np.append(np.exp(np.where(np.isfinite(self.logp), self.logp, byte_logp)), 0.0)
        sizes = np.array([len(p) for p in pieces])
        self.sizes = sizes
        self.starts = np.cumsum(sizes) - sizes
        self.flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    @classmethod
    def load(cls, path: str = MODEL, theta: float = THETA) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        byte_ids, pieces, logp = [-1] * 256, [b""] * n, np.full(n, -np.inf)
        kept = []
        for k in range(n):
            if sp.is_byte(k):
                byte_ids[int(sp.id_to_piece(k)[1:-1], 16)] = k
                pieces[k] = bytes([int(sp.id_to_piece(k)[1:-1], 16)])
            elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
                pieces[k] = sp.id_to_piece(k).replace("▁", " ").encode()
                kept.append(k)
        if min(byte_ids) < 0:
            raise ValueError("the model has no byte pieces, so encoding would lose characters")
        order = sorted(kept, key=lambda k: (-sp.get_score(k), k))
        norm = np.log((np.arange(1, len(order) + 2.0) ** -theta).sum())
        for rank, k in enumerate(order):
            logp[k] = -theta * np.log(rank + 1) - norm
        return cls(pieces, logp, byte_ids, -theta * np.log(len(order) + 1) - norm)

    @staticmethod
    def _slot(h: np.ndarray, k: int) -> np.ndarray:
        return ((h * _SPREAD[k % len(_SPREAD)]) >> np.uint64(64 - _TABLE_BITS)).view(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Trie node of every hash, or -1; a node is in the first table where no later one took its slot."""
        out = self.tables[0][self._slot(h, 0)] if self.tables else np.full(len(h), -1, dtype=np.int32)
        wrong = np.flatnonzero(out >= 0)
        wrong = wrong[self.hash[out[wrong]] != h[wrong]]
        for k, slots in enumerate(self.tables[1:], 1):
            got = slots[self._slot(h[wrong], k)]
            got[(got >= 0) & (self.hash[got] != h[wrong])] = -1
            out[wrong] = got
            wrong = wrong[got < 0]
        out[wrong] = -1
        return out

    def spell(self, ids: np.ndarray) -> bytes:
        """Bytes of the pieces, one after another."""
        size = self.sizes[ids]
        shift = self.starts[ids] - (np.cumsum(size) - size)
        return self.flat[np.repeat(shift, size) + np.arange(size.sum())].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a text from its piece ids."""
        return self.spell(ids)[1:]

    def same(self, ids: list[np.ndarray], texts: list[bytes]) -> list[bool]:
        """Whether each list of ids decodes to its text; as a rule all do, so they are spelled together first."""
        whole = b"".join(b" " + t if t else t for t in texts)
        if self.spell(np.concatenate(ids)) == whole:
            return [True] * len(ids)
        return [self.decode(x) == t for x, t in zip(ids, texts)]


_CHAR = np.ones(256, dtype=np.int64)
_CHAR[0xC0:0xE0], _CHAR[0xE0:0xF0], _CHAR[0xF0:] = 2, 3, 4


class Lattices:
    """States (word, bytes left) and their out-edges, longest first, of distinct words.

    States are numbered by bytes left, so the first `done` are the words' ends;
    base[w] is word w's first state.  Edges of state s are first[s]:first[s + 1]
    with piece, to (state after it), p (transition probability), cum and logp.
    """

    def __init__(self, vocab: Pieces, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        order = np.argsort(-sizes, kind="stable")
        starts, size_of = starts[order], sizes[order]
        words, most = len(sizes), int(sizes.max(initial=1))
        count = np.searchsorted(-size_of, -np.arange(most + 1), side="right")  # words with r bytes or more
        offset = np.concatenate([[0], np.cumsum(count)])
        states, self.done = int(offset[-1]), words
        rank = np.empty(words, dtype=np.int64)
        rank[order] = np.arange(words)
        self.base = offset[sizes] + rank
        left = np.repeat(np.arange(most + 1), count)
        word = np.arange(states) - offset[left]
        place = starts[word] + size_of[word] - left
        byte = raw[np.minimum(place, len(raw) - 1)]
        live = np.flatnonzero((left > 0) & ((byte & 0xC0) != 0x80))
        heads, char = live, np.minimum(_CHAR[byte[live]], left[live])
        known = np.zeros(states, dtype=bool)
        at, room = place[live], left[live]
        h = np.zeros(len(live), dtype=np.uint64)
        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        for size in range(1, vocab.longest + 1):
            h = h * _BASE + (raw[at + (size - 1)].astype(np.uint64) + np.uint64(1))
            node = vocab.find(h)
            fine = np.flatnonzero(node >= 0)
            node, live, h, at, room = node[fine], live[fine], h[fine], at[fine], room[fine]
            piece = vocab.node_piece[node]
            hit = np.flatnonzero(piece >= 0)
            found.append((live[hit], size, piece[hit]))
            if size <= 4:
                same = live[hit]
                known[same[np.minimum(_CHAR[byte[same]], left[same]) == size]] = True
            more = np.flatnonzero(vocab.node_more[node] & (room > size))
            live, h, at, room = live[more], h[more], at[more], room[more]
            if not len(live):
                break
        bare = ~known[heads]
        for k in range(4):  # byte pieces for characters without a piece
            here = bare & (char > k)
            low = left[heads[here]] - k
            at = offset[low] + word[heads[here]]
            found.insert(0, (at, 1, vocab.byte_ids[byte[at]]))
        degree = np.zeros(states, dtype=np.int64)
        for source, _, _ in found:
            degree[source] += 1
        self.first = np.concatenate([[0], np.cumsum(degree)])
        edges, fill = int(self.first[-1]), self.first[:-1].copy()
        self.piece, self.to = np.empty(edges, dtype=np.int32), np.empty(edges, dtype=np.int64)
        for source, size, piece in reversed(found):  # longest first
            slot, r = fill[source], left[source]
            self.piece[slot], self.to[slot] = piece, source - (offset[r] - offset[r - size])
            fill[source] += 1
        self.p = vocab.weight[self.piece]
        after = np.zeros(states)
        after[:words] = 1.0
        near = min(most, LINEAR)
        for r in range(1, near + 1):  # states with few bytes left first
            a, b = offset[r], offset[r + 1]
            lo, hi = self.first[a], self.first[b]
            if lo == hi:
                continue
            self.p[lo:hi] *= after[self.to[lo:hi]]
            has = np.flatnonzero(degree[a:b])
            after[a + has] = np.add.reduceat(self.p[lo:hi], self.first[a + has] - lo)
        self.p[: self.first[offset[near + 1]]] /= np.repeat(after[: offset[near + 1]], degree[: offset[near + 1]])
        if most > near:
            with np.errstate(divide="ignore"):
                after, logw = np.log(after), np.log(vocab.weight)
        for r in range(near + 1, most + 1):  # products of so many pieces can be too small for a double
            a, b = offset[r], offset[r + 1]
            lo, hi = self.first[a], self.first[b]
            if lo == hi:
                continue
            has = np.flatnonzero(degree[a:b])
            at, many = self.first[a + has] - lo, degree[a + has]
            x = logw[self.piece[lo:hi]] + after[self.to[lo:hi]]
            top = np.maximum.reduceat(x, at)
            x = np.exp(x - np.repeat(top, many))
            mass = np.add.reduceat(x, at)
            after[a + has] = top + np.log(mass)
            self.p[lo:hi] = x / np.repeat(mass, many)
        total = np.concatenate([[0.0], np.cumsum(self.p)])
        self.cum = total[1:] - np.repeat(total[self.first[:-1]], degree)
        self.cum[self.first[1:][degree > 0] - 1] = np.inf
        with np.errstate(divide="ignore"):
            self.logp = np.log(self.p)


def words_of(raw: np.ndarray, offsets: np.ndarray, vocab: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of words that cover all of raw, none across documents."""
    n = len(raw)
    begin = raw == 32
    begin[1:] &= raw[:-1] != 32
    if vocab.breaks_lines:
        line = raw == 10
        begin |= line
        begin[1:] |= line[:-1]
    begin[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(begin)
    sizes = np.diff(np.append(starts, n))
    return starts, sizes


def _place(seed: np.ndarray, *place: np.ndarray | int) -> np.ndarray:
    x = seed
    for k, v in enumerate(place):
        v = np.array([v], dtype=np.uint64) if isinstance(v, int) else v.astype(np.uint64)
        x = x + (v + np.uint64(1)) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 3)) & ((1 << 64) - 1))
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit places."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _uniform(seed: np.ndarray, *place: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1), a function of the seed and the place."""
    return _unit(_place(seed, *place))


_STEPS = mix(np.arange(7001, 7065, dtype=np.uint64))


class Path:
    """A drawn segmentation: the first `own` nodes are those of `parent`, then come its own (edges, log p before, keys)."""

    __slots__ = ("parent", "shared", "edge", "before", "word", "logp", "value", "key", "taken")


def _walk(lat: Lattices, word: np.ndarray, state: np.ndarray, seed: np.ndarray, turn: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges drawn from `state` to the end of every word; returns (occurrence, edge), ordered by occurrence and place."""
    live = np.flatnonzero(state >= lat.done)
    state, who, edges, step = state.copy(), [], [], 0
    base = _place(seed, turn, number)
    while len(live):
        u = _unit(base[live] + _STEPS[step % 64] + np.uint64(step // 64))
        e = lat.first[state[live]]
        more = np.flatnonzero(u > lat.cum[e])
        while len(more):
            e[more] += 1
            more = more[u[more] > lat.cum[e[more]]]
        who.append(live)
        edges.append(e)
        state[live] = lat.to[e]
        live = live[state[live] >= lat.done]
        step += 1
    count = np.bincount(np.concatenate(who), minlength=len(word)) if who else np.zeros(len(word), np.int64)
    at = np.cumsum(count) - count
    out = np.empty(int(count.sum()), dtype=np.int64)
    for k, (occurrence, e) in enumerate(zip(who, edges)):
        out[at[occurrence] + k] = e
    return np.repeat(np.arange(len(word)), count), out


def _keys(lat: Lattices, edge: np.ndarray, before: np.ndarray, top: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Perturbed maximum of all paths that leave at each node: a Gumbel of their mass below `top`."""
    rest = 1 - lat.p[edge]
    with np.errstate(divide="ignore"):
        mass = before + np.log(np.where(rest > 1e-12, rest, 0.0))
        return -np.logaddexp(-top, np.log(-np.log(draw)) - mass)


def sample_chunk(vocab: Pieces, raw: np.ndarray, offsets: np.ndarray, keys: np.ndarray, samples: int, seed: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For every document its segmentations (ids, log probability, perturbed log probability, log inclusion), best first."""
    docs = len(offsets) - 1
    full = np.flatnonzero(np.diff(offsets) > 0)
    text = np.insert(raw, offsets[full], np.uint8(32))
    at = np.append(offsets[full] + np.arange(len(full)), len(text))
    empty = [(np.zeros(0, np.int32), 0.0, 0.0, 0.0)]
    out: list[list] = [empty if offsets[k] == offsets[k + 1] else [] for k in range(docs)]
    if not len(full):
        return out
    starts, sizes = words_of(text, at, vocab)
    h = span_hashes(text, starts, starts + sizes)
    _, where, word = np.unique(h, return_index=True, return_inverse=True)
    lat = Lattices(vocab, text, starts[where], sizes[where])
    first = np.searchsorted(starts, at)
    owner = np.repeat(np.arange(len(full)), np.diff(first))
    number = np.arange(len(starts)) - first[owner]
    seeds = mix(mix(keys[full].view(np.uint64) + np.uint64(seed)) + np.uint64(seed))
    best = -np.log(-np.log(_uniform(seeds, 1 << 40)))
    paths: list[list[Path]] = [[] for _ in full]

    def extend(occ: np.ndarray, state: np.ndarray, turn: int, start: np.ndarray, top: np.ndarray) -> list[tuple]:
        """Per document: (edges, log p before each, words, total, keys) of paths on from `state` at occurrences `occ`."""
        who, edge = _walk(lat, word[occ], state, seeds[owner[occ]], turn, number[occ])
        doc = owner[occ[who]]
        logp = lat.logp[edge]
        bound = np.searchsorted(doc, np.arange(len(full) + 1))
        total = np.concatenate([[0.0], np.cumsum(logp)])
        before = total[:-1] - total[bound[:-1]][doc] + start[doc]
        # a node this unlikely cannot win: some node above it has a key, and a chance of exp(FAINT) less
        near = np.flatnonzero(before > FAINT)
        place = near - bound[:-1][doc[near]]
        key = np.full(len(edge), -np.inf)
        key[near] = _keys(lat, edge[near], before[near], top[doc[near]], _uniform(seeds[doc[near]], turn + 1000, place))
        return [(edge[a:b], before[a:b], occ[who[a:b]], float(total[b] - total[a] + start[d]), key[a:b]) for d, (a, b) in enumerate(zip(bound[:-1], bound[1:]))]

    everything = np.arange(len(starts))
    made = extend(everything, lat.base[word], 0, np.zeros(len(full)), best)
    for d, (edge, before, occ, logp, key) in enumerate(made):
        p = Path()
        p.parent, p.shared, p.edge, p.before, p.word, p.logp, p.value, p.key, p.taken = None, 0, edge, before, occ, logp, float(best[d]), key, {}
        paths[d].append(p)
    threshold = np.full(len(full), -np.inf)
    for turn in range(1, samples + 1):
        state = np.zeros(len(starts), dtype=np.int64)
        go = np.zeros(len(starts), dtype=bool)
        start, top = np.zeros(len(full)), np.full(len(full), -np.inf)
        opened: list[tuple] = []
        popped = []
        for d in range(len(full)):
            if len(paths[d]) < turn:
                continue
            value, source, t = -np.inf, None, -1
            for p in paths[d]:
                at_ = int(p.key.argmax()) if len(p.key) else -1
                if at_ >= 0 and p.key[at_] > value:
                    value, source, t = float(p.key[at_]), p, at_
            if source is not None:
                popped.append((d, value, source, t))
        if turn == samples:
            for d, value, _, _ in popped:
                threshold[d] = value
            break
        which, nodes = np.array([x[0] for x in popped], np.int64), np.array([x[3] for x in popped], np.int64)
        picks, draws = _uniform(seeds[which], turn + 2000, nodes).tolist(), _uniform(seeds[which], turn + 3000, nodes).tolist()
        for (d, value, source, t), u, draw in zip(popped, picks, draws):
            e0 = int(source.edge[t])
            s = int(np.searchsorted(lat.first, e0, side="right")) - 1
            choice = np.arange(lat.first[s], lat.first[s + 1])
            taken = source.taken.setdefault(t, [e0])
            weight = lat.p[choice].copy()
            weight[np.array(taken) - choice[0]] = 0
            e = int(choice[min(np.searchsorted(np.cumsum(weight), u * weight.sum()), len(choice) - 1)])
            while weight[e - choice[0]] == 0:
                e -= 1
            taken.append(e)
            rest = weight.sum() - weight[e - choice[0]]
            source.key[t] = -np.logaddexp(-value, np.log(-np.log(draw)) - (source.before[t] + np.log(rest))) if rest > 1e-12 else -np.inf
            occ = int(source.word[t])
            start[d] = source.before[t] + lat.logp[e]
            top[d] = value
            state[occ] = lat.to[e]
            state[occ + 1 : first[d + 1]] = lat.base[word[occ + 1 : first[d + 1]]]
            go[occ : first[d + 1]] = True
            opened.append((d, source, t, e, occ))
        if not opened:
            continue
        made = extend(np.flatnonzero(go), state[go], turn, start, top)
        for d, source, t, e, occ in opened:
            edge, before, words, logp, key = made[d]
            p = Path()
            p.parent, p.shared = source, t
            p.edge = np.concatenate([[e], edge])
            p.before = np.concatenate([[source.before[t]], before])
            p.word = np.concatenate([[occ], words])
            p.key = np.concatenate([[-np.inf], key])
            p.logp, p.value, p.taken = float(logp), float(top[d]), {}
            paths[d].append(p)
    for d, k in enumerate(full.tolist()):
        for p in paths[d]:
            parts, node, keep = [], p, None
            while node is not None:
                parts.append(node.edge if keep is None else node.edge[:keep])
                keep, node = node.shared, node.parent
            ids = lat.piece[np.concatenate(parts[::-1])]
            gap = p.logp - threshold[d]
            sure = 0.0 if threshold[d] == -np.inf else (float(gap) if gap < -30 else float(np.log(-np.expm1(-np.exp(min(gap, 700.0))))))
            out[k].append((ids, p.logp, p.value, sure))
    return out


SCHEMA = "doc_id long, sample int, ids array<int>, n_pieces int, log_prob double, perturbed double, log_inclusion double, decodes boolean"


def _sample(vocab: Pieces, samples: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            keys = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            for i, j in chunks(offsets, CHUNK_BYTES):
                part = raw[offsets[i] : offsets[j]]
                offs = offsets[i : j + 1] - offsets[i]
                found = sample_chunk(vocab, part, offs, keys[i:j], samples, seed)
                data = part.tobytes()
                flat = [(k, s, *x) for s in range(samples) for k, one in enumerate(found) for x in one[s : s + 1]]
                owner, sample, ids, logp, value, sure = (list(x) for x in zip(*flat))
                same = vocab.same(ids, [data[offs[k] : offs[k + 1]] for k in owner])
                sizes = np.array([len(x) for x in ids])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i).take(pa.array(owner, pa.int64())),
                        pa.array(sample, pa.int32()),
                        lists,
                        pa.array(sizes, pa.int32()),
                        pa.array(logp, pa.float64()),
                        pa.array(value, pa.float64()),
                        pa.array(sure, pa.float64()),
                        pa.array(same, pa.bool_()),
                    ],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    return run


def _vocabulary(spark: SparkSession, model: str | None) -> Pieces:
    return Pieces.load(model or spark.conf.get("spark.tessera.pieces", MODEL))


def sample_segmentations(docs: DataFrame, model: str | None = None, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """A row for every text of docs(doc_id, text) and drawn segmentation, as in SCHEMA; `decodes`: ids decode to the text."""
    vocab = _vocabulary(docs.sparkSession, model)
    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), _sample(vocab, samples, seed), SCHEMA)


def _decode(vocab: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                values = ids.values
                texts.append(None if values is None else vocab.decode(values.to_numpy()).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sample"), pa.array(texts, pa.string())], names=["doc_id", "sample", "text"])

    return run


def decode_segmentations(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, sample and the text of encoded(doc_id, sample, ids)."""
    return map_arrow(encoded.select("doc_id", "sample", "ids"), _decode(_vocabulary(encoded.sparkSession, model)), "doc_id long, sample int, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(table(spark, sf_dir, "documents"))
