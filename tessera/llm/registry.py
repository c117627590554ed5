"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import op1_ngram_jaccard_join, op2_sentencepiece, op3_substring_dedup, op4_pii, op5_toxicity, op6_line_dedup, op7_lm_scoring, op8_decontamination, op9_media, op10_sharding, op11_fill_in_middle, op12_simhash, op13_spelling

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join.query,
    "op2_sentencepiece": op2_sentencepiece.query,
    "op3_substring_dedup": op3_substring_dedup.query,
    "op4_pii": op4_pii.query,
    "op5_toxicity": op5_toxicity.query,
    "op6_line_dedup": op6_line_dedup.query,
    "op7_lm_scoring": op7_lm_scoring.query,
    "op8_decontamination": op8_decontamination.query,
    "op9_media": op9_media.query,
    "op10_sharding": op10_sharding.query,
    "op11_fill_in_middle": op11_fill_in_middle.query,
    "op12_simhash": op12_simhash.query,
    "op13_spelling": op13_spelling.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join.ORACLE,
    "op3_substring_dedup": op3_substring_dedup.ORACLE,
    "op6_line_dedup": op6_line_dedup.ORACLE,
    "op10_sharding": op10_sharding.ORACLE,
    "op11_fill_in_middle": op11_fill_in_middle.ORACLE,
    "op12_simhash": op12_simhash.ORACLE,
    "op13_spelling": op13_spelling.ORACLE,
}
