"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

from graphtide.llm import decontaminate, divergence, langid, mixing, near_dedup, quality, secrets, substring_bytes, substring_words, topk, toxicity, url_filter, whitening

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_substring_bytes": substring_bytes.op5_substring_bytes,
    "op6_mixing": mixing.op6_mixing,
    "op7_substring_words": substring_words.op7_substring_words,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_exact_topk": topk.op12_exact_topk,
    "op13_source_divergence": divergence.op13_source_divergence,
}
ORACLES = {name: sql for name, sql in {
    "op1_language_id": langid.ORACLE_SQL,
    "op2_secret_scan": secrets.ORACLE_SQL,
    "op3_url_filter": url_filter.ORACLE_SQL,
    "op4_near_dedup": near_dedup.ORACLE_SQL,
    "op5_substring_bytes": substring_bytes.ORACLE_SQL,
    "op6_mixing": mixing.ORACLE_SQL,
    "op7_substring_words": substring_words.ORACLE_SQL,
    "op8_toxicity": toxicity.ORACLE_SQL,
    "op9_quality_rules": quality.ORACLE_SQL,
    "op10_decontamination": decontaminate.ORACLE_SQL,
    "op11_embedding_whitening": whitening.ORACLE_SQL,
    "op12_exact_topk": topk.ORACLE_SQL,
    "op13_source_divergence": divergence.ORACLE_SQL,
}.items() if sql is not None}
