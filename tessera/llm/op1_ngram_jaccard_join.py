"""N-gram Jaccard join by chosen-path recursion.

Sets are the distinct 5-word shingles of a text (fewer words: one shingle of all
of them).  Texts with equal sets are one class, counted once from here on.  A
class has a signature of POSITIONS minhashes, and (position, value) pairs are
the tokens of the join: in every run the root picks each position with
probability 1 / (threshold * POSITIONS), and classes that share the token there
share a node.  Nodes of up to SMALL classes are leaves.  In a larger one, classes
that agree on average with its members (a few pivots) are central: the node is
compared whole for them and they do not recurse.  A partner shares each node of
a central class with a chance of at least the threshold, so the first `enough`
nodes in which it is central suffice and it leaves the others.  All others pick
anew and split, down to DEPTH levels.  A pair at the threshold survives a level like
a branching process with one expected child, so `runs_needed` runs give the
target recall (more similar pairs are surer).

A leaf keeps the members whose signature comes within SIGMAS deviations of the
threshold with another's (a pair at the threshold fails this with a chance of
3e-5); the rest are compared by brute force on whole shingle sets, exactly.
Leaves with equal members are one; a large leaf is dealt out in pairs of blocks, so no task
holds more than two blocks of sets.  A pair in several leaves counts in the
smallest common one.  What leaves a task is, per class, its number of linked
documents and the smallest class of its component there: rows grow with classes,
not pairs.
Connected components of those links, by min-label rounds with pointer jumping
(each checkpointed), are the groups.

Edge cases: a text without words (or null) is its own group with no links;
repeated rows are copies of each other; a null doc_id gets a null class and no
links and is no one's partner; doc_id is cast to long (what cannot be cast is
null); other columns are not read and pass through `keep_one` under any name; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._arrow import columns, map_arrow
from tessera.llm._store import cut, shuffle_partitions, sweep, table
from tessera.llm._text import Words, gram_starts, grams, mix, text_chunks

SHINGLE = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
POSITIONS = 64
DEPTH = 2
SMALL = 128
BLOCK = 512
SIGMAS = 4
PIVOTS = 16
CENTRAL = 0.5

_MULTIPLIERS = mix(np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def runs_needed(threshold: float, depth: int, target: float, positions: int = POSITIONS) -> int:
    """Runs after which a pair at the threshold was together in some leaf with the target probability."""
    together = 1.0
    for _ in range(depth):
        together = 1 - (1 - together / (threshold * positions)) ** (threshold * positions)
    return math.ceil(math.log(1 - target) / math.log(1 - together))


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all documents, bounds by document); repeated shingles are repeated."""
    h = words.hashes()
    at = gram_starts(words, k)
    g = grams(h, k)[at] if len(at) else np.zeros(0, np.uint64)
    doc = words.doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        own = []
        for d in short:
            x = words.counts[d : d + 1].astype(np.uint64)
            for y in h[words.first[d] : words.first[d + 1]]:
                x = mix(x * np.uint64(0xD6E8FEB86659FD93) + y)
            own.append(x[0])
        doc = np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        doc, g = doc[order], np.concatenate([g, np.array(own, np.uint64)])[order]
    return g, np.searchsorted(doc, np.arange(len(words.counts) + 1))


def _fingerprint(s: np.ndarray) -> int:
    """Of a set given as sorted distinct hashes."""
    if not len(s):
        return 0
    total = mix(np.array([s.sum(), mix(s).sum(), len(s)], dtype=np.uint64))
    return int(mix((total * np.array([3, 5, 7], dtype=np.uint64)).sum(keepdims=True)).view(np.int64)[0])


SKETCH = "doc_id long, cls long, n int, sig binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, words in text_chunks(batch.column("text")):
            g, bound = shingles(words)
            filled = np.flatnonzero(bound[:-1] < bound[1:])
            sig = np.zeros((j - i, POSITIONS), dtype=np.uint32)
            for p in range(POSITIONS if len(filled) else 0):
                values = ((g * _MULTIPLIERS[p]) >> np.uint64(32)).astype(np.uint32)
                sig[filled, p] = np.minimum.reduceat(values, bound[filled])
            sets = [np.unique(g[a:b]) for a, b in zip(bound[:-1], bound[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(i, j - i),
                    pa.array([_fingerprint(s) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([x.tobytes() for x in sig], pa.binary()),
                ],
                names=["doc_id", "cls", "n", "sig"],
            )


def _picked(node: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) pairs that the nodes pick: a function of the node alone."""
    draws = mix(node[:, None] * np.uint64(0x9E3779B97F4A7C15) + _MULTIPLIERS[None, :])
    return np.nonzero(draws < np.uint64(int(2**64 / (threshold * POSITIONS))))


def _child(node: np.ndarray, position: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(mix(node + np.uint64(0x2545F4914F6CDD1D) * (position.astype(np.uint64) + np.uint64(1))) + value.astype(np.uint64))


NODES = "node long, pick int, cls long"


def _nodes(node: np.ndarray, pick: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(pick, pa.int32()), pa.array(cls)], names=["node", "pick", "cls"])


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, POSITIONS)


def _roots(runs: int, threshold: float):
    roots = mix(np.arange(1, runs + 1, dtype=np.uint64))
    run_of, position = _picked(roots, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                sig, cls = _signatures(batch.column("sig")), batch.column("cls").to_numpy()
                for k, (r, p) in enumerate(zip(run_of, position)):
                    yield _nodes(_child(np.full(len(cls), roots[r]), np.full(len(cls), p), sig[:, p]), np.full(len(cls), k), cls)

    return run


def _split(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                sig, cls = _signatures(batch.column("sig")), batch.column("cls").to_numpy()
                node = batch.column("node").to_numpy().view(np.uint64)
                row, p = _picked(node, threshold)
                yield _nodes(_child(node[row], p, sig[row, p]), batch.column("pick").to_numpy()[row], cls[row])

    return run


def _sized(rows: DataFrame, key: str = "node", only: Column | None = None) -> DataFrame:
    """Rows in groups of `key` with two members or more, with the group's size and a fingerprint of its members.

    Sizes are counted with partial sums and dealt anew by another column, so that the join reads both sides from exchanges
    of its own and Spark can split the partition of a group that holds a large part of all rows.  `only`: a condition on
    groups, made of aggregates.
    """
    sizes = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("size"),
        F.bit_xor(F.xxhash64("cls")).alias("members"),
        F.bit_xor(F.xxhash64("cls", F.lit(7))).alias("members2"),
        (F.lit(True) if only is None else only).alias("wanted"),
    )
    sizes = sizes.where("size > 1 and wanted").drop("wanted")
    return rows.join(sizes.repartition(shuffle_partitions(rows.sparkSession), "members"), key)


def _central(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether a class agrees on average with its node's pivots in CENTRAL of the positions."""
    for batch in batches:
        central = []
        for own, others in zip(batch.column("sig"), batch.column("pivots")):
            pivots = np.frombuffer(b"".join(x.as_py() for x in others), np.uint32).reshape(-1, POSITIONS)
            central.append(bool((np.frombuffer(own.as_py(), np.uint32)[None, :] == pivots).mean() >= CENTRAL))
        if central:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "pick", "cls")), pa.array(central)], names=["node", "pick", "cls", "central"])


def _named(sized: DataFrame) -> DataFrame:
    """Leaves by their members, so that leaves with equal members are one."""
    return sized.select(F.xxhash64("size", "members", "members2").alias("leaf"), "cls", F.col("size").cast("int").alias("size"))


def leaves(classes: DataFrame, threshold: float, target: float) -> tuple[DataFrame, DataFrame]:
    """(leaf, cls, size) of classes(cls, sig) after all runs: of split nodes (distinct), and of dense ones."""
    runs = runs_needed(threshold, DEPTH, target)
    sketches = classes.select("cls", "sig")
    parts = shuffle_partitions(classes.sparkSession)
    sized = cut(_sized(map_arrow(sketches, _roots(runs, threshold), NODES)).coalesce(parts))
    small = _named(sized.where(F.col("size") <= SMALL))
    large = sized.where(F.col("size") > SMALL).select("node", "pick", "cls", "size").join(sketches, "cls")
    # about PIVOTS members of every large node, by a hash
    pivots = large.where(F.pmod(F.xxhash64("cls", "node"), F.col("size")) < PIVOTS).groupBy("node").agg(F.collect_list("sig").alias("pivots"))
    pivots = pivots.repartition(parts, F.xxhash64("node"))  # an exchange of its own, as in _sized
    met = large.join(pivots, "node", "left").select("node", "pick", "cls", "sig", F.coalesce("pivots", F.array("sig")).alias("pivots"))
    marked = cut(map_arrow(met, _central, "node long, pick int, cls long, central boolean"))
    sweep(classes.sparkSession)
    enough = math.ceil(math.log(1 - target) / math.log(1 - threshold)) + 2
    order = Window.partitionBy("cls", "central").orderBy("pick", "node")
    marked = marked.withColumn("rank", F.row_number().over(order)).where(~F.col("central") | (F.col("rank") <= enough))
    dense = _named(_sized(marked.select("node", "pick", "cls", "central"), only=F.max("central")))
    rest = marked.where(~F.col("central")).select("node", "pick", "cls").join(sketches, "cls").select("node", "pick", "cls", "sig")
    split = _named(_sized(map_arrow(rest, _split(threshold), NODES)))
    return small.unionByName(split).distinct(), dense


def _likely(least: int):
    """Members of each task that agree with another member in at least `least` positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []

        def flush() -> tuple[list[int], list[int]]:
            left = [r for r in rows if not r["right"]]
            right = [r for r in rows if r["right"]] if rows and rows[0]["both"] else left
            if not left or not right or len(left) + (right is not left) * len(right) < 2:
                return [], []
            a, b = (np.frombuffer(b"".join(r["sig"] for r in x), np.uint32).reshape(-1, POSITIONS) for x in (left, right))
            agree = np.zeros((len(a), len(b)), dtype=np.int16)
            for p in range(POSITIONS):
                agree += a[:, p][:, None] == b[:, p][None, :]
            near = agree >= least
            if right is left:
                np.fill_diagonal(near, False)
            kept = {left[k]["cls"] for k in np.flatnonzero(near.any(axis=1))} | {right[k]["cls"] for k in np.flatnonzero(near.any(axis=0))}
            return [rows[0]["leaf"]] * len(kept), list(kept)

        for batch in batches:
            leaf, cls = [], []
            for row in batch.to_pylist():
                if row["task"] != task:
                    found = flush()
                    leaf, cls = leaf + found[0], cls + found[1]
                    task, rows = row["task"], []
                rows.append(row)
            if leaf:
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(cls, pa.int64())], names=["leaf", "cls"])
        leaf, cls = flush()
        if leaf:
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(cls, pa.int64())], names=["leaf", "cls"])

    return run


def likely(found: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Leaves (leaf, cls, size) reduced to members whose signature has a partner there within SIGMAS
    deviations below the threshold, a sketch filter before whole sets are fetched."""
    spread = (threshold * (1 - threshold) / POSITIONS) ** 0.5
    least = math.floor(POSITIONS * (threshold - SIGMAS * spread))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    dealt = (
        found.join(classes.select("cls", "sig"), "cls")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.xxhash64("leaf", F.least("own", "other"), F.greatest("own", "other")).alias("task"),
            "leaf",
            (F.col("own") != F.col("other")).alias("both"),
            (F.col("own") > F.col("other")).alias("right"),
            "cls",
            "sig",
        )
        .repartition(shuffle_partitions(found.sparkSession), "task")
        .sortWithinPartitions("task")
    )
    kept = cut(map_arrow(dealt, _likely(least), "leaf long, cls long").distinct())
    return _named(_sized(kept, "leaf"))


DEALT = "task long, leaf long, side int, both boolean, cls long, copies long, shingles binary, leaves binary"


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every leaf of a class and every pair of blocks that its block is in."""
    names = [x.split()[0] for x in DEALT.split(", ")]
    for whole in batches:
        for i, j, words in text_chunks(whole.column("text")):
            batch = whole.slice(i, j - i)
            g, bound = shingles(words)
            out: list[tuple] = []
            held = 0
            for k, row in enumerate(batch.select(["cls", "copies", "places"]).to_pylist()):
                s = np.unique(g[bound[k] : bound[k + 1]])
                cls = row["cls"]
                if _fingerprint(s) != cls:
                    continue
                body = s.tobytes()
                own = np.array(sorted(p["leaf"] for p in row["places"]), np.int64).tobytes()
                for p in row["places"]:
                    blocks = -(-p["size"] // BLOCK)
                    b = int(mix(np.array([cls], np.int64).view(np.uint64))[0] % np.uint64(blocks))
                    for other in range(blocks):
                        x, y = min(b, other), max(b, other)
                        task = mix(np.array([p["leaf"]], np.int64).view(np.uint64) + np.uint64(x * 1_000_003 + y)).view(np.int64)[0]
                        out.append((int(task), p["leaf"], int(b == y and x != y), x != y, cls, row["copies"], body, own))
                        held += len(body)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, o)) for o in out], schema=_DEALT)
                            out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, o)) for o in out], schema=_DEALT)


_DEALT = pa.schema(
    [("task", pa.int64()), ("leaf", pa.int64()), ("side", pa.int32()), ("both", pa.bool_()), ("cls", pa.int64()), ("copies", pa.int64()), ("shingles", pa.binary()), ("leaves", pa.binary())]
)


def common(rows: list[np.ndarray], cols: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of intersections between sorted distinct arrays; only values in two arrays or more are laid out."""
    both = rows + cols
    sizes = np.array([len(x) for x in both])
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), sizes)
    order = np.argsort(flat, kind="stable")
    value, owner = flat[order], owner[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = value[1:] != value[:-1]
    group = np.cumsum(new) - 1
    shared = np.bincount(group)[group] > 1 if len(value) else new
    owner = owner[shared]
    column = np.cumsum(new[shared]) - 1
    out = np.zeros((len(rows), len(cols)), dtype=np.float64)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        table_ = np.zeros((len(both), min(width, int(column[hi - 1]) - a + 1)), dtype=np.float32)
        table_[owner[lo:hi], column[lo:hi] - a] = 1
        out += table_[: len(rows)] @ table_[len(rows) :].T
    return out


LINKS = "cls long, links long, partner long"


def compare(leaf: int, members: list[dict], threshold: float) -> list[tuple[int, int, int]]:
    """(cls, linked documents, smallest class of its component here) of one task's classes that have links."""
    left = [m for m in members if m["side"] == 0]
    right = [m for m in members if m["side"] == 1] if members[0]["both"] else left
    if not left or not right:
        return []
    sets = {m["cls"]: np.frombuffer(m["shingles"], np.uint64) for m in members}
    a, b = [sets[m["cls"]] for m in left], [sets[m["cls"]] for m in right]
    shared = common(a, b)
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    linked = shared >= threshold * (na[:, None] + nb[None, :] - shared) - 1e-9
    ca, cb = np.array([m["cls"] for m in left]), np.array([m["cls"] for m in right])
    linked &= ca[:, None] != cb[None, :]
    if not linked.any():
        return []
    before = {m["cls"]: (x := np.frombuffer(m["leaves"], np.int64))[x < leaf] for m in members}
    counted = linked & (common([before[c] for c in ca], [before[c] for c in cb]) == 0)
    wa, wb = np.array([m["copies"] for m in left]), np.array([m["copies"] for m in right])
    out: dict[int, list[int]] = {}

    def add(cls: np.ndarray, links: np.ndarray, partner: np.ndarray, any_: np.ndarray) -> None:
        for k in np.flatnonzero(any_).tolist():
            now = out.setdefault(int(cls[k]), [0, int(cls[k])])
            now[0] += int(links[k])
            now[1] = min(now[1], int(partner[k]))

    top = np.iinfo(np.int64).max
    la, lb = ca.copy(), cb.copy() if right is not left else None
    while True:  # smallest class of each component, by rounds along the links
        other = la if lb is None else lb
        na_ = np.minimum(la, np.where(linked, other[None, :], top).min(axis=1))
        nb_ = None if lb is None else np.minimum(lb, np.where(linked, na_[:, None], top).min(axis=0))
        still = (na_ == la).all() and (lb is None or (nb_ == lb).all())
        la, lb = na_, nb_
        if still:
            break
    add(ca, counted @ wb, la, linked.any(axis=1))
    if right is not left:
        add(cb, wa @ counted, lb, linked.any(axis=0))
    return [(c, n, p) for c, (n, p) in out.items()]


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, members = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(members) > 1 and (found := compare(members[0]["leaf"], members, threshold)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["cls", "links", "partner"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["task"] != task:
                    yield from flush()
                    task, members = row["task"], []
                if all(row["cls"] != m["cls"] for m in members[-1:]):
                    members.append(row)
        yield from flush()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(cls, label): the smallest class of the connected component of every class in edges(cls, partner)."""
    both = cut(edges.where("cls <> partner").select("cls", "partner").union(edges.where("cls <> partner").select("partner", "cls")).distinct())
    labels = cut(both.groupBy("cls").agg(F.least(F.col("cls"), F.min("partner")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("cls", "partner"), "partner").groupBy("cls").agg(F.min("label").alias("near"))
        met = labels.join(near, "cls", "left").select("cls", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = labels.select(F.col("cls").alias("label"), F.col("label").alias("far"))
        met = cut(met.join(jump, "label", "left").select("cls", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        labels = met.select("cls", "label")
        if met.where("old <> label").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its group), n_links (documents at the threshold or above), copy_id
    (smallest doc_id with the same shingle set) and n_copies, for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = cut(map_arrow(rows.where(F.col("doc_id").isNotNull()), _sketch, SKETCH))
    classes = cut(
        sketch.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    )
    split, dense = leaves(classes, threshold, target)
    found = likely(split, classes, threshold).unionByName(dense)
    sweep(spark)
    places = found.groupBy("cls").agg(F.collect_set(F.struct("leaf", "size")).alias("places"))
    wanted = places.join(classes.select("cls", "rep", "copies"), "cls").withColumnRenamed("rep", "doc_id")
    texts = rows.join(wanted, "doc_id").select("text", "cls", "copies", "places")
    parts = shuffle_partitions(spark)
    dealt = map_arrow(texts, _deal, DEALT).repartition(parts, "task").sortWithinPartitions("task", "cls")
    links = cut(map_arrow(dealt, _compare(threshold), LINKS))
    sweep(spark)
    per_class = links.groupBy("cls").agg(F.sum("links").alias("links"))
    labels = components(links)
    grouped = (
        classes.select("cls", "rep", "copies")
        .join(labels, "cls", "left")
        .join(per_class, "cls", "left")
        .select("cls", "rep", "copies", F.coalesce("label", "cls").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    smallest = grouped.groupBy("label").agg(F.min("rep").alias("class_id"))
    smallest = smallest.repartition(parts, "class_id")  # an exchange of its own: one label may hold a third of all classes
    grouped = grouped.join(smallest, "label").select("cls", "rep", "copies", "links", "class_id")
    out = sketch.select("doc_id", "cls", "n").join(grouped, "cls", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("rep", "doc_id").alias("copy_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )
    null = F.lit(None).cast("long")
    nameless = rows.where(F.col("doc_id").isNull()).select(
        "doc_id", null.alias("class_id"), F.lit(0).cast("long").alias("n_links"), null.alias("copy_id"), F.lit(1).cast("long").alias("n_copies")
    )
    return out.unionByName(nameless)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents whose group holds a smaller doc_id; rows of one doc_id stay or go together."""
    gone = near_duplicates(docs, threshold).where("doc_id <> class_id").select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti").select(*columns(docs.columns))
    return named.unionByName(docs.where(F.col("doc_id").isNull()))  # rows without an id would all meet in one task of the join


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: every pair of texts that share a shingle, by brute force
ORACLE = rf"""
WITH RECURSIVE split_ AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
spot_ AS (SELECT doc_id, a, unnest(range(1, greatest(len(a) - {SHINGLE - 1}, 1) + 1)) AS i FROM split_ WHERE len(a) > 0),
shingle_ AS (SELECT DISTINCT doc_id, array_to_string(a[i:i + {SHINGLE - 1}], ' ') AS g FROM spot_),
size_ AS (SELECT doc_id, count(*) AS n FROM shingle_ GROUP BY 1),
pair_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingle_ x JOIN shingle_ y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link_ AS (SELECT a, b, c = p.n AND c = q.n AS same FROM pair_ JOIN size_ p ON p.doc_id = a JOIN size_ q ON q.doc_id = b WHERE c >= {THRESHOLD} * (p.n + q.n - c) - 1e-9),
reach_ AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach_.a, link_.b FROM reach_ JOIN link_ ON link_.a = reach_.b),
class_ AS (SELECT a AS doc_id, min(b) AS class_id FROM reach_ GROUP BY 1),
count_ AS (SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (WHERE same) AS n_same, min(b) FILTER (WHERE same) AS first_same FROM link_ GROUP BY 1)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, least(doc_id, coalesce(first_same, doc_id))::BIGINT AS copy_id, (coalesce(n_same, 0) + 1)::BIGINT AS n_copies
FROM class_ LEFT JOIN count_ USING (doc_id)"""
