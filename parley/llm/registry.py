"""Queries of the corpus operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from parley.llm import ann, bpe, exact_dedup, filter_audit, jaccard, langid, lm_score, packing, pii, prefix_trie, quality, quality_rules, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack_sequences": packing.query,
    "op2_nearest": ann.query,
    "op3_quality": quality.query,
    "op4_language": langid.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_lm_score": lm_score.query,
    "op7_toxicity": toxicity.query,
    "op8_encode_decode": bpe.query,
    "op9_personal_data": pii.query,
    "op10_jaccard_join": jaccard.query,
    "op11_filter_audit": filter_audit.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_quality_rules": quality_rules.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_lm_score": lm_score.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_quality_rules": quality_rules.ORACLE,
}
