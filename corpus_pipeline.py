"""From raw documents to sampled piece ids, in five stages.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of `documents` (the last returns segmentations):

1. toxicity: texts that the FTRL model scores at THRESHOLD or above go;
2. line dedup: lines that are boilerplate of their source go from the texts;
3. n-gram Jaccard join: of each group of near duplicates the smallest doc_id stays;
4. benchmark decontamination: texts that hold a test item go;
5. SentencePiece: distinct sampled segmentations of what is left.

Rows with null ids, null or empty texts pass every filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import op1_ngram_jaccard_join, op2_sentencepiece, op5_toxicity, op6_line_dedup, op8_decontamination
from tessera.llm._store import cut, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op5_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return op5_toxicity.reject(docs, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    counts = tuple(op6_line_dedup.unused(name, docs.columns) for name in ("n_lines", "n_dropped"))
    out = op6_line_dedup.dedup_lines(docs, counts=counts)
    if "n_chars" in docs.columns:
        changed = F.when(F.col(counts[1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return out.drop(*counts)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_ngram_jaccard_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_sentencepiece.sample_segmentations(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("sentencepiece", segment),
]

#: FTRL, the join's sampling and the segmentations are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is checkpointed, so a lost executor costs one stage at most."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
