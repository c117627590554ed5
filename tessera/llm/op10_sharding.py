"""Sharding by a Feistel permutation of global row numbers [native].

Rows get global numbers 0..N-1, a keyed Feistel network with cycle walking
permutes the numbers, and the permuted number p gives shard p mod S and slot
p div S.  Shard sizes differ by at most one, slots are gapless, and the place
of any row can be computed from its number alone (`place`).

Global numbers follow (bucket of the key, key, crc, size).  Rows are dealt by
ranges of that order, and of a hash of their place in the input where all else
is equal, so one key (or none) with a third of all rows, and even equal rows,
spread over many tasks.  A row's number is its partition's offset (a table of one
row a partition) plus its index there; the dealt rows are checkpointed, so that
both come from one dealing.  Only (key, size, crc) is shuffled, never the text.

Edge cases: a null text counts as empty (size 1, crc 0); a null key is a key of
its own; repeated rows get neighbouring numbers, so the multiset of results is
the same on every run; texts of any length are measured whole; an empty table gives
an empty result; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._store import cut, shuffle_partitions, table

PRIME = 2147483647
SPREAD = 48271
ROUNDS = 4
MAX_WALK = 32
SEED = 20240229
BUCKETS = 1024


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """(multiplier, addend) of every round, below the prime."""
    keys, x = [], seed % PRIME
    for _ in range(rounds):
        x = (x * 16807 + 12345) % PRIME
        a = x % (PRIME - 2) + 1
        x = (x * 16807 + 12345) % PRIME
        keys.append((a, x))
    return keys


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _round(v: Column, key: tuple[int, int]) -> Column:
    """Keyed function of a half; every product stays below 2**62."""
    return _let((v % PRIME * key[0] + key[1]) % PRIME, lambda t: t * t % PRIME)


def feistel(x: Column, left: Column, right: Column, keys: list[tuple[int, int]]) -> Column:
    """Permutation of 0 <= x < left * right; halves are numbers modulo left and modulo right."""
    def step(i: int, s: Column) -> Column:
        if i == len(keys):
            return s["r"] * left + s["l"]
        a, b = s["l"], s["r"]
        new = (
            F.struct(((a + _round(b, keys[i])) % left).alias("l"), b.alias("r"))
            if i % 2 == 0
            else F.struct(a.alias("l"), ((b + _round(a, keys[i])) % right).alias("r"))
        )
        return _let(new, lambda t: step(i + 1, t))

    start = F.struct((x % left).alias("l"), F.floor(x / left).cast("long").alias("r"))
    return _let(start, lambda s: step(0, s))


def place(number: Column, total: Column, seed: int) -> Column:
    """Permuted position of a row number below total.

    The domain is left * right with left = ceil(sqrt(total)), which exceeds total
    by less than left; a walk that lands outside is repeated (cycle walking).  A
    cycle holds fewer than `left` outside numbers, and one step stays outside with
    probability below 1/left, so MAX_WALK steps end every walk: by counting for
    total <= 1024, with a failure chance under total**-14 beyond.
    """
    keys = round_keys(seed)
    left = F.greatest(F.ceil(F.sqrt(total.cast("double"))).cast("long"), F.lit(1).cast("long"))
    right = F.greatest(F.ceil(total / left).cast("long"), F.lit(1).cast("long"))
    walk = lambda x: F.aggregate(
        F.sequence(F.lit(1), F.lit(MAX_WALK)), x, lambda acc, _: F.when(acc < total, acc).otherwise(feistel(acc, left, right, keys))
    )
    return _let(feistel(number, left, right, keys), lambda p: F.when(p < total, p).otherwise(walk(p)))


def number_rows(rows: DataFrame, key: str, order: list[str], buckets: int) -> DataFrame:
    """Add `number` (0..N-1) and `total`; order of numbers: (bucket, key, order)."""
    bucket = (F.pmod(F.coalesce(F.col(key).cast("long"), F.lit(-1).cast("long")), F.lit(PRIME)) * SPREAD) % PRIME % buckets
    by = ["bucket", key, *order, "tie"]
    placed = rows.withColumn("bucket", bucket).withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    dealt = placed.repartitionByRange(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by).drop("bucket", "tie")
    # partition number above 33 bits, index in the partition below
    dealt = cut(dealt.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(everything).alias("total"))
    # `offsets` has one row a partition, whatever the input
    return (
        dealt.withColumn("part", part)
        .join(F.broadcast(offsets), "part")
        .withColumn("number", F.col("offset") + F.col("at").bitwiseAND((1 << 33) - 1))
        .drop("part", "offset", "at")
    )


def shard(docs: DataFrame, shards: int = 16, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs(doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    numbered = number_rows(rows, "doc_id", ["text_crc32", "size"], buckets)
    return numbered.withColumn("place", place(F.col("number"), F.col("total"), seed)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def _feistel_sql(source: str) -> str:
    """One pass of the network over source(id, x, total, a, b)."""
    f = lambda v, k: f"((({v} % {PRIME}) * {k[0]} + {k[1]}) % {PRIME} * ((({v} % {PRIME}) * {k[0]} + {k[1]}) % {PRIME}) % {PRIME})"
    keys = round_keys(SEED)
    inner = f"(SELECT *, x % a AS l, x // a AS r FROM {source})"
    for i, k in enumerate(keys):
        inner = f"(SELECT * REPLACE ((l + {f('r', k)}) % a AS l) FROM {inner})" if i % 2 == 0 else f"(SELECT * REPLACE ((r + {f('l', k)}) % b AS r) FROM {inner})"
    return f"SELECT id, r * a + l AS x, total, a, b FROM {inner}"


ORACLE = f"""
WITH RECURSIVE step_ AS (
  SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS k FROM range(256) AS q(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, k + 1 FROM step_ WHERE k < 8),
table_ AS (SELECT list(v ORDER BY i) AS tb FROM step_ WHERE k = 8),
hex_ AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
byte_ AS (SELECT doc_id, n, list_transform(range(0, n), lambda i: (('0x' || h[2 * i + 1:2 * i + 2])::INT)::BIGINT) AS bytes FROM hex_),
crc_ AS (SELECT doc_id, (n + 1)::BIGINT AS size, xor(list_reduce(bytes, lambda s, x: xor(tb[(xor(s, x) & 255) + 1], s >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM byte_, table_),
number_ AS (
  SELECT *, row_number() OVER (ORDER BY ((coalesce(doc_id, -1) % {PRIME} + {PRIME}) % {PRIME}) * {SPREAD} % {PRIME} % {BUCKETS}, doc_id NULLS FIRST, text_crc32, size) - 1 AS id,
         count(*) OVER () AS total, ceil(sqrt(count(*) OVER ()))::BIGINT AS a FROM crc_),
dim_ AS (SELECT *, id AS x, ceil(total / a)::BIGINT AS b FROM number_),
walk_ AS ({_feistel_sql("(SELECT id, x, total, a, b FROM dim_)")} UNION ALL {_feistel_sql("(SELECT * FROM walk_ WHERE x >= total)")})
SELECT doc_id, size, text_crc32, 'rows' AS law, (walk_.x % 16)::INT AS shard, (walk_.x // 16)::BIGINT AS slot, NULL::INT AS grown_shard
FROM number_ JOIN walk_ USING (id) WHERE walk_.x < walk_.total"""
