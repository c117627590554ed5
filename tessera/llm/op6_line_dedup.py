"""Line dedup by site-relative frequency [native].

Per host, the share of its pages that contain a line (trimmed of spaces, once a
page) is the line's ratio.  A line on at least `min_pages` pages whose ratio
exceeds `max_ratio` is boilerplate of that host; all its occurrences there go.

Counting ships (host, line hash) after one distinct per page, with map-side
partial sums, so a common line or a hot host shrinks before the shuffle.  The
ratios of a host sum to its mean number of distinct lines a page, so a host has
at most that mean / max_ratio boilerplate lines: its set fits in one row.  The
table of sets is broadcast only if its measured size is small; otherwise hosts
are salted and joined by shuffle.

Edge cases: a null text stays null with no lines; texts of any length are read whole;
blank lines always stay; a
null host is one host of its own (as is a host of one zero byte); repeated rows count
as pages of their own; other columns pass through under any name: the counts are
named `n_lines` and `n_dropped`, or as the caller says, and a column of the input
that has that name is replaced only then; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._arrow import columns
from tessera.llm._store import cut, table

MAX_RATIO = 0.05
MIN_PAGES = 5
BROADCAST_LINES = 200_000
SALTS = 64


def _lines(text):
    return F.split(text, "\n")


def _key(line):
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    """(site, lines: array of line hashes) of every host of pages(site, text) that has boilerplate."""
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key))
    counts = pages.select("site", F.explode(keys).alias("line")).groupBy("site", "line").agg(F.count(F.lit(1)).alias("n"))
    # lines of one host may be a third of all, so its total goes to every salt
    salted = counts.where(F.col("n") >= min_pages).withColumn("salt", F.pmod(F.xxhash64("line"), F.lit(SALTS)).cast("int"))
    spread = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    over = salted.join(spread, ["site", "salt"]).where(F.col("n") > max_ratio * F.col("pages"))
    return over.groupBy("site").agg(F.array_sort(F.collect_list("line")).alias("lines"))


def _dropped(docs: DataFrame, host: str, max_ratio: float, min_pages: int) -> DataFrame:
    """(row: struct of the other columns of docs, text, lines, kept: array of its lines or null for a null text)."""
    whole = F.struct(*[F.col(c) for c in columns([c for c in docs.columns if c != "text"])]).alias("row")
    pages = docs.select(whole, F.coalesce(F.col(columns([host])[0]).cast("string"), F.lit("\0")).alias("site"), F.col("text"))
    sets = cut(boilerplate(pages.select("site", "text"), max_ratio, min_pages))
    total = sets.agg(F.sum(F.size("lines"))).first()[0] or 0
    sets = sets.withColumnRenamed("lines", "drop")
    if total <= BROADCAST_LINES:
        joined = pages.join(F.broadcast(sets), "site", "left")
    else:
        salt = F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")
        spread = sets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.withColumn("salt", salt).join(spread, ["site", "salt"], "left")
    lines = _lines(F.col("text"))
    kept = F.when(F.col("drop").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("drop"), _key(x))))
    return joined.select("row", "text", lines.alias("lines"), kept.alias("kept"))


def unused(name: str, taken: list[str]) -> str:
    """`name`, with underscores until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def dedup_lines(
    docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, counts: tuple[str, str] | None = ("n_lines", "n_dropped")
) -> DataFrame:
    """docs with text less its host's boilerplate lines, plus (long) numbers of lines and of dropped ones, named by `counts`."""
    found = _dropped(docs, host, max_ratio, min_pages)
    null = F.col("text").isNull()
    n_lines = F.when(null, F.lit(0)).otherwise(F.size("lines")).cast("long")
    n_kept = F.when(null, F.lit(0)).otherwise(F.size("kept")).cast("long")
    added = dict(zip(counts or (), (n_lines, n_lines - n_kept)))
    out = [
        F.array_join("kept", "\n").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in added
    ]
    return found.select(*out, *[v.alias(k) for k, v in added.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup_lines(docs).select("doc_id", "source", "n_lines", "n_dropped", "text")


def stage_sql(source: str) -> str:
    """DuckDB SQL: rows of `source` (doc_id, source, text, ...) with n_lines, n_dropped and the kept text as kept_text."""
    return f"""
    WITH rows_ AS (SELECT *, row_number() OVER () AS rid_, coalesce(source, chr(1)) AS site_ FROM {source}),
    lines_ AS (
      SELECT rid_, site_, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
      FROM rows_ WHERE text IS NOT NULL),
    total_ AS (SELECT site_, count(*) AS pages FROM rows_ GROUP BY site_),
    count_ AS (SELECT site_, trim(line) AS k, count(DISTINCT rid_) AS n FROM lines_ WHERE trim(line) <> '' GROUP BY ALL),
    drop_ AS (
      SELECT c.site_, c.k FROM count_ c JOIN total_ t USING (site_)
      WHERE c.n >= {MIN_PAGES} AND c.n > {MAX_RATIO} * t.pages),
    kept_ AS (
      SELECT l.rid_, count(*) AS n_lines, count(d.k) AS n_dropped,
             coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE d.k IS NULL), '') AS kept
      FROM lines_ l LEFT JOIN drop_ d ON d.site_ = l.site_ AND d.k = trim(l.line) GROUP BY l.rid_)
    SELECT r.* EXCLUDE (rid_, site_), coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_dropped, 0)::BIGINT AS n_dropped, k.kept AS kept_text
    FROM rows_ r LEFT JOIN kept_ k USING (rid_)"""


ORACLE = f"SELECT doc_id, source, n_lines, n_dropped, kept_text AS text FROM ({stage_sql('documents')})"
