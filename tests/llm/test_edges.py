"""Nulls, empty and long texts, repeats, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import (
    op1_ngram_jaccard_join as op1,
    op2_sentencepiece as op2,
    op3_substring_dedup as op3,
    op4_pii as op4,
    op5_toxicity as op5,
    op6_line_dedup as op6,
    op7_lm_scoring as op7,
    op8_decontamination as op8,
    op9_media as op9,
    op10_sharding as op10,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, site string, `links` int"
_r = random.Random(5)
LONG = " ".join(_r.choice(["alpha", "beta", "gamma", "délta", "x1"]) + str(_r.randrange(5000)) for _ in range(30000))
ROWS = [
    (1, "a plain text with some words in it\nand a second line", "en", "s", 50, None, "x", 1),
    (1, "a plain text with some words in it\nand a second line", "en", "s", 50, None, "x", 1),
    (2, None, None, None, None, None, None, None),
    (None, "text without an id but with words", "en", None, 5, 0.1, None, None),
    (3, "", "en", "s", 0, None, None, None),
    (4, " \n\t ", "en", "s", 4, None, None, None),
    (5, LONG, "en", "s", len(LONG), None, None, None),
    (6, LONG + " tail", "en", "s", len(LONG) + 5, None, None, None),
    (7, "one", "en", "t", 3, None, None, None),
    (8, "mail me at jo.doe@mail.example.com or +1 (555) 010-9999 now", "en", "t", 3, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    """A folder with these documents, and one with empty tables."""
    out = {}
    labels = [(1, 1, 0), (5, 1, 0), (7, 0, 1), (7, 0, 1), (8, None, None), (None, 1, 1)]
    items = [(0, "what is it that the quick brown fox did over there. it jumped over the lazy dog again"), (1, None), (2, ""), (None, "loose item text")]
    for name, rows, marks, tests in (("full", ROWS, labels, items), ("empty", [], [], [])):
        path = tmp_path_factory.mktemp(name)
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame(tests, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        out[name] = str(path)
    return out


QUERIES = [op1, op2, op3, op4, op5, op6, op7, op8, op9, op10]


@pytest.mark.parametrize("op", QUERIES, ids=lambda m: m.__name__.rsplit(".", 1)[1])
def test_empty_tables(spark, tables, op):
    assert op.query(spark, tables["empty"]).collect() == []


def test_join(spark, tables):
    got = {r.doc_id: r for r in op1.query(spark, tables["full"]).collect()}
    assert got[1].n_links == 1 and got[1].n_copies == 2
    assert got[6].class_id == 5 and got[5].n_links == 1
    assert got[2].class_id == 2 and got[2].n_links == 0 and got[3].n_copies == 1
    assert got[None].class_id is None and got[None].n_links == 0
    assert op1.query(spark, tables["full"]).count() == len(ROWS)


def test_segmentations(spark, tables):
    got = op2.query(spark, tables["full"]).collect()
    assert all(r.decodes for r in got)
    assert [(r.n_pieces, r.log_prob, r.log_inclusion) for r in got if r.doc_id in (2, 3)] == [(0, 0.0, 0.0)] * 2
    ones = [(r.sample, tuple(r.ids)) for r in got if r.doc_id == 1]
    assert len(ones) == 4 and len(set(ones)) == 2


def test_substrings(spark, tables):
    got = op3.query(spark, tables["full"]).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS) and by[2].n_words == 0 and by[3].n_removed == 0
    assert by[5].n_removed == 0 and by[6].n_words == 30001 and by[6].n_removed == 30000
    assert {r.n_removed for r in got if r.doc_id == 1} == {0}


def test_substrings_of_one_id(spark):
    """Rows of one doc_id (or none) with unlike texts are documents of their own; equal rows keep each other."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (5, b), (None, c), (None, c), (9, c), (None, b + " " + c), (None, None)]
    got = [(r.doc_id, r.n_words, r.n_removed) for r in op3.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = {(1, 40): [0], (5, 40): [0, 0, 40], (9, 40): [40], (None, 0): [0]}
    for (k, n), removed in want.items():
        if k != 5:
            assert sorted(x for i, m, x in got if (i, m) == (k, n)) == removed
    kept = [x for i, m, x in got if i is None and m]
    assert sorted(kept) in ([0, 0, 40], [0, 40, 40])  # whichever comes first by its hash keeps c
    assert sorted(x for i, _, x in got if i == 5) == [40, 40, 40]  # b is in an earlier row without id
    got = op3.dedup_substrings(spark.createDataFrame([(1, a), (5, a), (5, b)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.kept_text) for r in got) == [(1, a), (5, ""), (5, b)]


CLASHES = "doc_id long, text string, source string, n_lines int, n_dropped int, `a.b` int, __site string, score double, `sig` int, task int, pii int, feature int, tile int, bucket int"


@pytest.fixture(scope="module")
def clashes(spark):
    rows = [(k, f"shared line\nline {k} of a text with some words in it", "s", 7, 9, 3, "x", 0.25, 1, 2, 3, 4, 5, 6) for k in range(8)]
    return spark.createDataFrame(rows, CLASHES)


def test_clashing_columns(spark, clashes):
    """Columns of the input pass through under any name, but for those that an operator says it replaces."""
    before = clashes.first()
    for out in (op1.keep_one(clashes), corpus_pipeline.drop_boilerplate(spark, clashes, ""), op8.decontaminate(clashes, spark.createDataFrame([(1, "no such item at all")], "item_id long, text string"))):
        row = out.orderBy("doc_id").first()
        assert out.columns == clashes.columns and [row[c] for c in out.columns if c != "text"] == [before[c] for c in out.columns if c != "text"]
    row = op6.dedup_lines(clashes, counts=("lines", "gone")).where("doc_id = 0").first()
    assert (row.n_lines, row.n_dropped, row["a.b"], row["__site"], row.lines, row.gone) == (7, 9, 3, "x", 2, 1)
    row = op6.dedup_lines(clashes).where("doc_id = 0").first()
    assert (row.n_lines, row.n_dropped, row["a.b"]) == (2, 1, 3)
    model = op5.fit(clashes, spark.createDataFrame([(0, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int"))
    assert op5.score(clashes, model, "toxicity").first().score == 0.25 and op5.score(clashes, model).first().score != 0.25
    assert op5.reject(clashes, model, 2.0).columns == clashes.columns
    assert op4.tag(clashes, None).first().pii == [] and op4.tag(clashes, None).first()["a.b"] == 3
    for op in (op1.near_duplicates, op2.sample_segmentations, op3.dedup_substrings, op7.score, op9.store, op10.shard):
        assert op(clashes).count() >= 8, op


def test_media_without_bytes(spark):
    stored = op9.store(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).withColumn("feature", F.lit(1)).withColumn("a.b", F.lit(2))
    both = stored.unionByName(stored.withColumn("doc_id", F.lit(2).cast("long")).withColumn("media", F.lit(None).cast("binary")))
    got = {r.doc_id: r for r in op9.features(both).collect()}
    assert len(got[1].feature) == 16 and got[1]["a.b"] == 2
    assert got[2].feature is None and got[2].payload_bytes is None and got[2].tile is None


def test_sharding_of_one_key(spark):
    """One key, none, and equal rows with a large part of all rows lie in many tasks, and are numbered as any."""
    rows = spark.range(3000).select(
        F.when(F.col("id") < 1000, F.lit(7)).when(F.col("id") < 2000, F.lit(None)).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 2 == 0, F.lit("same")).otherwise(F.concat(F.lit("t"), "id")).alias("text"),
    )
    got = op10.shard(rows).collect()
    assert sorted((r.slot, r.shard) for r in got) == [(k // 16, k % 16) for k in range(3000)]


def test_pii(spark, tables):
    got = {r.doc_id: r for r in op4.query(spark, tables["full"]).collect()}
    assert (got[8].n_email, got[8].n_phone) == (1, 1)
    assert got[2].base_sha256 == op4.digest([]) and got[2].spans == ""
    assert got[8].base_sha256 == op4.digest(op4.base_spans(ROWS[-1][1]))


def test_toxicity(spark, tables):
    got = op5.query(spark, tables["full"]).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3, 4)}) == 1
    assert all(r.held_out is not None for r in got)


def test_lines(spark, tables, docs):
    got = {r.doc_id: r for r in op6.query(spark, tables["full"]).collect()}
    assert got[2].text is None and got[2].n_lines == 0
    assert got[3].text == "" and got[4].text == " \n\t " and got[4].n_lines == 2
    out = op6.dedup_lines(docs, max_ratio=0.1, min_pages=2)
    assert [r.text for r in out.where("doc_id = 1").collect()] == ["", ""]
    assert out.columns[: len(docs.columns)] == docs.columns


def test_scoring(spark, tables):
    got = {r.doc_id: r for r in op7.query(spark, tables["full"]).collect()}
    assert got[2].n_tokens == got[3].n_tokens == 1 and got[5].n_tokens == 30001
    assert all(r.score <= 0 and r.n_known <= r.n_tokens for r in got.values())


def test_leaks(spark, docs):
    item = "what is it that the quick brown fox did over there. it jumped over the lazy dog again"
    rows = [*ROWS, (9, "before " + item + " after", "en", "s", 1, None, None, None), (None, item, "en", "s", 1, None, None, None)]
    both = spark.createDataFrame(rows, SCHEMA)
    items = spark.createDataFrame([(0, item), (1, None), (2, ""), (0, item)], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in op8.leaks(both, items).collect()) == ["9", "9", "None", "None"]
    clean = op8.decontaminate(both, items)
    assert clean.columns == both.columns and clean.count() == len(ROWS)


def test_media(spark, tables):
    got = op9.query(spark, tables["full"]).collect()
    by = {r.doc_id: r for r in got}
    assert by[2].n_bytes == by[3].n_bytes == 0 and by[2].payload_bytes == 192 and by[2].media_sha256 == by[3].media_sha256
    assert by[5].payload_bytes % 192 == 0 and len(got) == len(ROWS)


def test_sharding(spark, tables):
    got = op10.query(spark, tables["full"]).collect()
    assert sorted((r.slot, r.shard) for r in got) == [(k // 16, k % 16) for k in range(len(ROWS))]
    assert all(r.size == 1 and r.text_crc32 == 0 for r in got if r.doc_id in (2, 3))


@pytest.mark.parametrize("folder", ["full", "empty"])
def test_stages(spark, tables, folder):
    docs = spark.read.parquet(f"{tables[folder]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables[folder])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            left = {r.doc_id for r in out.select("doc_id").collect()}
            if folder == "full":
                assert {None, 2, 3, 4} <= left, name
        else:
            assert out.select("ids").count() >= (8 if folder == "full" else 0)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, tables[folder])
    assert kept.where(F.col("doc_id") == 6).count() == 0
