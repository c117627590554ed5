"""Fill-in-middle transformation of whole texts.

A text is cut into n code points by the tokenizers library: a Split pre-tokenizer
with isolated regex matches gives the offsets of its pieces and needs no training.
The offsets have two levels.  Matches of RUN code points each (the last may be
shorter) cover the text; a run that is asked for is split again into matches of one
code point.  So n is RUN for every run before the last and the length of the last
run's offset array, and the cut of rank r is the entry r mod RUN of the offset array
of run r div RUN.  (One match for each code point of every text gives the same cuts;
it takes more than the whole budget of time, see README.)

Two ranks cut the text into prefix, middle and suffix: the smaller and the larger of
h1 mod (n + 1) and h2 mod (n + 1).  h1 to h4 are the first four 8-digit groups of the
hex sha256 of "<seed>:<doc_id>".  A text is left plain if it is empty, holds one of
the marks, or if h3 mod 100 is at least `share`; of the others h4 mod 100 below
`spm_share` gives spm (suffix, prefix, middle) and the rest psm (prefix, suffix,
middle).

Edge cases: a null text counts as empty (plain, n 0, output empty); a null doc_id is
written as an empty string in the hash; equal rows get equal results; texts of any
length are read in blocks of BLOCK runs, so a long one needs memory for its
own text and one block's pieces; an empty table gives an empty result; other columns
pass through `transform`, but for those named as its results, which are replaced.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._arrow import map_text
from tessera.llm._store import table

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SEED = 1
SHARE = 90
SPM_SHARE = 20
RUN = 256
#: runs in a block of text that is handed over at once
BLOCK = 64

FIELDS = [
    T.StructField("n", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
]


class Splitter:
    """Split pre-tokenizers for runs of `run` code points and for single ones; made once a task."""

    def __init__(self, run: int = RUN) -> None:
        from tokenizers import Regex, pre_tokenizers

        self.run = run
        self.runs = pre_tokenizers.Split(Regex(f"(?m:.{{1,{run}}})"), "isolated")
        self.singles = pre_tokenizers.Split(Regex("(?m:.)"), "isolated")


class CodePoints:
    """Code points of one text by ranks; starts: the offset of every run."""

    def __init__(self, text: str, splitter: Splitter) -> None:
        self.text, self.splitter = text, splitter
        block = splitter.run * BLOCK
        self.starts = [i + a for i in range(0, len(text), block) for _, (a, _) in splitter.runs.pre_tokenize_str(text[i : i + block])]
        self.singles: dict[int, list[int]] = {}
        self.n = splitter.run * (len(self.starts) - 1) + len(self.offsets(len(self.starts) - 1)) if self.starts else 0

    def offsets(self, run: int) -> list[int]:
        """Offset array of the single code points of a run."""
        if run not in self.singles:
            a = self.starts[run]
            b = self.starts[run + 1] if run + 1 < len(self.starts) else None
            self.singles[run] = [a + s for _, (s, _) in self.splitter.singles.pre_tokenize_str(self.text[a:b])]
        return self.singles[run]

    def cut(self, rank: int) -> int:
        """Offset of the code point of a rank; the text's end for rank n."""
        run, left = divmod(rank, self.splitter.run)
        if rank == self.n:
            last = self.offsets(len(self.starts) - 1) if self.starts else []
            return last[-1] + 1 if last else 0
        return self.offsets(run)[left]


def draws(doc_id: object, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def rearrange(text: str, doc_id: object, splitter: Splitter, seed: int, share: int, spm_share: int) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    points = CodePoints(text, splitter)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not points.n or h3 % 100 >= share or any(mark in text for mark in MARKS):
        return points.n, "plain", None, None, text
    low, high = sorted((h1 % (points.n + 1), h2 % (points.n + 1)))
    a, b = points.cut(low), points.cut(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_share:
        return points.n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return points.n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, seed: int = SEED, share: int = SHARE, spm_share: int = SPM_SHARE, keep: list[str] | None = None, run: int = RUN) -> DataFrame:
    """docs(doc_id, text, ...) with n, form, prefix_chars, middle_chars and output; `keep`: columns to keep (all if None)."""

    def make():
        splitter = Splitter(run)

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows = [rearrange(t or "", i, splitter, seed, share, spm_share) for i, t in zip(ids, texts)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string())
            return {f.name: pa.array([r[k] for r in rows], kind) for k, (f, kind) in enumerate(zip(FIELDS, kinds))}

        return work

    kept = docs.columns if keep is None else keep
    return map_text(docs, kept, FIELDS, make, read=() if "doc_id" in kept else ("doc_id",))


def restored(output: str = "output", form: str = "form"):
    """The exact text, rebuilt from output and form alone: a text that is not plain holds no mark of its own, and no mark
    can come about where a mark meets a text."""
    part = F.split(F.col(output), "<[PSM]>", 4)
    return (
        F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2]))
        .when(F.col(form) == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(F.col(output))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"), keep=["doc_id"])
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


ORACLE = f"""
WITH text_ AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
draw_ AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM text_),
form_ AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {SHARE} THEN 'plain' WHEN h4 % 100 < {SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM draw_),
part_ AS (SELECT *, substring(t, 1, low) AS p, substring(t, low + 1, high - low) AS m, substring(t, high + 1) AS s FROM form_),
out_ AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o,
         CASE form WHEN 'plain' THEN t ELSE p || m || s END AS r FROM part_)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(o) AS output_sha256, sha256(r) AS restored_sha256 FROM out_"""
