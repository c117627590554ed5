"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A text's words (A-Z lower-cased) give 4-word shingles, repeats included, joined by
one space (fewer words: the whole sequence).  h is a shingle's XXH64 with seed 42; a
fingerprint bit is 1 if it is set in over half the h.  Texts without words have
fingerprint zero.  Rows with equal fingerprints are one from here on.

Two fingerprints that differ in at most `bits` = 4 bits differ in at most 4 of their 8
bytes, so they share at least 4 positional bytes: the guaranteed minimum.  Posting
lists of single positional bytes would hold 1/256 of all fingerprints each and their
pairs would grow with the square of the corpus, so lists are kept for sets of three
positions: of any 4 shared positions 3 form one of the 20 sets of `triples()`, so every
link meets in a list.  A list of over BLOCK fingerprints is replaced by the lists of
its set with each fourth position, where every link of it meets too (it shares a
fourth byte).  What is still larger is dealt out in pairs of blocks, so no task holds
more than two blocks and nothing is cut off.  Within a list the shared positional
bytes of each pair are tallied, pairs that reach the minimum are verified by their
differing bits, and what leaves a task is the smallest fingerprint of each
fingerprint's component there: rows, not pairs.  Components of those links over the
whole corpus come from min-label rounds.

Edge cases: a null text counts as empty and has fingerprint zero, linked like any
other; repeated rows share a fingerprint; a null doc_id is linked like any other but
is no component's name (a component of null ids only has none); doc_id is cast to
long; texts of any length are read whole, in pieces of PIECE bytes; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._arrow import map_arrow, map_text
from tessera.llm._store import cut, shuffle_partitions, table
from tessera.llm.op1_ngram_jaccard_join import components

SHINGLE = 4
XXH_SEED = 42
BITS = 4
BYTES = 8
BLOCK = 1024
PIECE = 1 << 20

_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())


def _pieces(text: bytes, size: int) -> Iterator[list[bytes]]:
    """Words of a text in lists, cut at white space after `size` bytes or more."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end].split()
        at = end


def shingle_hashes(text: bytes, k: int = SHINGLE, size: int = PIECE) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of lower-cased UTF-8, repeats included, in pieces."""
    from xxhash import xxh64_intdigest

    carried: list[bytes] = []
    any_ = False
    for piece in _pieces(text, size):
        words = carried + piece
        if len(words) >= k:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = [0, *(ends[: len(words) - k] + 1).tolist()]
            any_ = True
            yield np.array([xxh64_intdigest(joined[a:b], XXH_SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64)
        carried = words[max(0, len(words) - k + 1) :]
    if not any_ and carried:
        yield np.array([xxh64_intdigest(b" ".join(carried), XXH_SEED)], np.uint64)


def fingerprint(text: str, k: int = SHINGLE, size: int = PIECE) -> int:
    """Unsigned 64-bit fingerprint."""
    ones, total = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text.encode().translate(_FOLD), k, size):
        for part in np.array_split(h, -(-len(h) // 65536)):
            ones += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        total += len(h)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id (long) and fp (the fingerprint's 64 bits as a signed long) of every row of docs(doc_id, text)."""

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            made = np.array([fingerprint(t) if t else 0 for t in batch.column("text").to_pylist()], np.uint64)
            return {"fp": pa.array(made.view(np.int64))}

        return work

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], [T.StructField("fp", T.LongType())], make)


def triples(positions: int = BYTES) -> list[tuple[int, ...]]:
    """Sets of three positions of which every four positions hold one: positions lie in three circles of about equal size;
    a set lies in one of them, or has two positions in one and the third in the next."""
    circle = [p % 3 for p in range(positions)]
    out = []
    for t in combinations(range(positions), 3):
        at = sorted(circle[p] for p in t)
        if at[0] == at[2] or tuple(at) in ((0, 0, 1), (1, 1, 2), (0, 2, 2)):
            out.append(t)
    return out


def _mask(positions: tuple[int, ...]) -> int:
    """Signed 64-bit mask of the bytes at the positions."""
    x = sum(255 << 8 * p for p in positions)
    return x - (1 << 64) if x >> 63 else x


def postings(rows: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """(at, bytes, fp): the list of each set of positions (its mask) and its bytes in which a fingerprint stands."""
    lists = F.array(*[F.struct(F.lit(_mask(s)).alias("at"), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("bytes")) for s in sets])
    return rows.select("fp", F.explode(lists).alias("list")).select("list.at", "list.bytes", "fp")


def deeper(lists: DataFrame) -> DataFrame:
    """The lists of every set of positions in (at, bytes, fp) with one position more."""
    wider = [F.lit(_mask((p,))) for p in range(BYTES)]
    free = F.filter(F.array(*wider), lambda m: F.col("at").bitwiseAND(m) == 0)
    at = lists.select("fp", F.explode(F.transform(free, lambda m: F.col("at").bitwiseOR(m))).alias("at"))
    return at.select("at", F.col("fp").bitwiseAND(F.col("at")).alias("bytes"), "fp").distinct()


def sized(lists: DataFrame) -> DataFrame:
    """Rows of lists with two fingerprints or more, with the list's size; sizes are dealt anew, so that Spark can split the
    partition of a list that holds a large part of all rows."""
    sizes = lists.groupBy("at", "bytes").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return lists.join(sizes.repartition(shuffle_partitions(lists.sparkSession), "size", "bytes", "at"), ["at", "bytes"])


def dealt(lists: DataFrame, block: int = BLOCK) -> DataFrame:
    """(task, both, right, fp): every list in pairs of blocks; a list of one block is one task."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    return (
        lists.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            F.xxhash64("at", "bytes", F.least("own", "other"), F.greatest("own", "other")).alias("task"),
            (F.col("own") != F.col("other")).alias("both"),
            (F.col("own") > F.col("other")).alias("right"),
            "fp",
        )
    )


def compare(left: np.ndarray, right: np.ndarray | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest of its component here) of the fingerprints that have a link; right is None: within left."""
    other = left if right is None else right
    differ = left[:, None] ^ other[None, :]
    shared = np.zeros(differ.shape, np.int8)
    for p in range(BYTES):
        shared += (differ >> np.uint64(8 * p)) & np.uint64(255) == 0
    linked = shared >= BYTES - bits
    linked &= np.bitwise_count(differ) <= bits
    a, b = np.nonzero(linked)
    both = left if right is None else np.concatenate([left, right])
    b = b + (0 if right is None else len(left))
    a, b = a[both[a] != both[b]], b[both[a] != both[b]]
    rank = np.argsort(np.argsort(both, kind="stable"), kind="stable")
    by_rank = np.argsort(rank)
    label = rank.copy()
    while len(a):  # smallest rank along the links, then along the labels
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[by_rank[new]])
        if (new == label).all():
            break
        label = new
    some = np.unique(np.concatenate([a, b]))
    return both[some], both[by_rank[label[some]]]


def _compare(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # columns task, both, right, fp of the task that goes on

        def found(task, both, right, fp) -> list[tuple[np.ndarray, np.ndarray]]:
            edge = np.flatnonzero(np.diff(task)) + 1
            out = []
            for i, j in zip([0, *edge], [*edge, len(task)]):
                if j - i > 1 and (not both[i] or (right[i:j].any() and not right[i:j].all())):
                    x = fp[i:j]
                    out.append(compare(x[~right[i:j]], x[right[i:j]], bits) if both[i] else compare(x, None, bits))
            return out

        def batch_of(links) -> Iterator[pa.RecordBatch]:
            links = [x for x in links if len(x[0])]
            if links:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*links))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["cls", "partner"])

        for batch in batches:
            if not len(batch):
                continue
            cols = [batch.column("task").to_numpy(), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("both", "right")), batch.column("fp").to_numpy().view(np.uint64)]
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)] if held else cols
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            yield from batch_of(found(*[c[:last] for c in cols]) if last else [])
            held = [c[last:].copy() for c in cols]
        if held:
            yield from batch_of(found(*held))

    return run


def links(rows: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(cls, partner): links that connect the components of rows(fp), whose fingerprints are distinct."""
    first = cut(sized(postings(rows, triples())))
    second = sized(deeper(first.where(F.col("size") > block).select("at", "bytes", "fp")))
    parts = shuffle_partitions(rows.sparkSession)
    tasks = dealt(first.where(F.col("size") <= block), block).unionByName(dealt(second, block))
    return map_arrow(tasks.repartition(parts, "task").sortWithinPartitions("task"), _compare(bits), "cls long, partner long").distinct()


def near_duplicates(docs: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id of its component) of every row of docs(doc_id, text).

    `bits` up to 4, for which the 8 bytes of a fingerprint guarantee 4 shared ones."""
    if not 0 <= bits <= BITS:
        raise ValueError(f"bits must lie between 0 and {BITS}")
    parts = shuffle_partitions(docs.sparkSession)
    prints = cut(fingerprints(docs))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(links(distinct.select("fp"), bits, block)).withColumnRenamed("cls", "fp")
    labelled = distinct.join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    smallest = smallest.repartition(parts, "component_id")  # an exchange of its own: one label may hold a third of all
    named = labelled.join(smallest, "label").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _xxh64_sql() -> str:
    """CTEs from gram_(doc_id, g) to hash_(doc_id, h): XXH64 of the bytes of g.

    Arithmetic modulo 2**64 in UHUGEINT; a rotation by r is the product with 2**r modulo 2**64 - 1 (all ones apart)."""
    # fixed values: the five primes of XXH64
    p1, p2, p3, p4, p5 = (f"{x}::UHUGEINT" for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    m, m1 = "18446744073709551616::UHUGEINT", "18446744073709551615::UHUGEINT"
    rotated = lambda x, r: f"(({x}) * {1 << r}::UHUGEINT) % {m1}"
    times = lambda a, b: f"((({a}) * ({b})) % {m})"
    plus = lambda a, b: f"((({a}) + ({b})) % {m})"
    round_ = lambda a, w: times(rotated(plus(a, times(w, p2)), 31), p1)
    hex_at = lambda at, n: "('0x' || " + " || ".join(f"x[2 * ({at}) + {2 * k + 1}:2 * ({at}) + {2 * k + 2}]" for k in reversed(range(n))) + ")::UBIGINT::UHUGEINT"
    start = [(XXH_SEED + 11400714785074694791 + 14029467366897019727) % 2**64, (XXH_SEED + 14029467366897019727) % 2**64, XXH_SEED, (XXH_SEED - 11400714785074694791) % 2**64]
    lanes = ", ".join(f"list_reduce(list_transform(range(n // 32), lambda i: {hex_at(f'32 * i + {8 * j}', 8)}), lambda s, w: {round_('s', 'w')}, {v}::UHUGEINT) AS v{j}" for j, v in enumerate(start))
    merged = plus(plus(rotated("v0", 1), rotated("v1", 7)), plus(rotated("v2", 12), rotated("v3", 18)))
    for j in range(4):
        merged = plus(times(f"xor({merged}, {round_('0::UHUGEINT', f'v{j}')})", p1), p4)
    eights = f"list_reduce(list_transform(range((n % 32) // 8), lambda i: {hex_at('n - n % 32 + 8 * i', 8)}), lambda s, w: {plus(times(rotated('xor(s, ' + round_('0::UHUGEINT', 'w') + ')', 27), p1), p4)}, a)"
    four = f"CASE WHEN n % 8 >= 4 THEN {plus(times(rotated(f'xor(a, {times(hex_at("n - n % 8", 4), p1)})', 23), p2), p3)} ELSE a END"
    ones = f"list_reduce(list_transform(range(n % 4), lambda i: {hex_at('n - n % 4 + i', 1)}), lambda s, w: {times(rotated(f'xor(s, {times("w", p5)})', 11), p1)}, a)"
    return f"""byte_ AS (SELECT doc_id, hex(encode(g)) AS x, octet_length(encode(g)) AS n FROM gram_),
lane_ AS (SELECT doc_id, x, n, {lanes} FROM byte_),
merge_ AS (SELECT doc_id, x, n, {plus(f"CASE WHEN n >= 32 THEN {merged} ELSE {XXH_SEED + 2870177450012600261}::UHUGEINT END", "n::UHUGEINT")} AS a FROM lane_),
eight_ AS (SELECT doc_id, x, n, {eights} AS a FROM merge_),
four_ AS (SELECT doc_id, x, n, {four} AS a FROM eight_),
one_ AS (SELECT doc_id, {ones} AS a FROM four_),
mix1_ AS (SELECT doc_id, {times("xor(a, a // 8589934592::UHUGEINT)", p2)} AS a FROM one_),
mix2_ AS (SELECT doc_id, {times("xor(a, a // 536870912::UHUGEINT)", p3)} AS a FROM mix1_),
hash_ AS (SELECT doc_id, xor(a, a // 4294967296::UHUGEINT)::UBIGINT AS h FROM mix2_)"""


#: every pair of distinct fingerprints, by brute force
ORACLE = rf"""
WITH RECURSIVE word_ AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
spot_ AS (SELECT doc_id, a, unnest(range(1, greatest(len(a) - {SHINGLE - 1}, 1) + 1)) AS i FROM word_ WHERE len(a) > 0),
gram_ AS (SELECT doc_id, array_to_string(a[i:i + {SHINGLE - 1}], ' ') AS g FROM spot_),
{_xxh64_sql()},
bit_ AS (SELECT doc_id, {" + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))} AS f FROM hash_ GROUP BY 1),
print_ AS (SELECT doc_id, coalesce(f, 0::UBIGINT)::UBIGINT AS f FROM documents LEFT JOIN bit_ USING (doc_id)),
node_ AS (SELECT f, min(doc_id) AS first FROM print_ GROUP BY 1),
link_ AS (SELECT a.f AS a, b.f AS b FROM node_ a, node_ b WHERE a.f <> b.f AND bit_count(xor(a.f, b.f)) <= {BITS}),
reach_ AS (SELECT f AS a, f AS b FROM node_ UNION SELECT reach_.a, link_.b FROM reach_ JOIN link_ ON link_.a = reach_.b),
group_ AS (SELECT a AS f, min(first) AS component_id FROM reach_ JOIN node_ ON node_.f = reach_.b GROUP BY 1)
SELECT doc_id, lower(printf('%016x', f)) AS fingerprint, component_id FROM print_ JOIN group_ USING (f)"""
