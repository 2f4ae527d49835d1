"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridpv.llm import (
    best_fit_packing,
    byte_bpe,
    chat_format,
    exact_dedup,
    fingerprints,
    html_extract,
    merkle_manifest,
    minhash_dedup,
    phrases,
    quality_rules,
    substring_dedup,
    token_counts,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": byte_bpe.op1_byte_bpe,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_html_extract": html_extract.op4_html_extract,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_minhash_dedup": minhash_dedup.op7_minhash_dedup,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_best_fit_packing": best_fit_packing.op9_best_fit_packing,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_phrases": phrases.op11_phrases,
    "op12_exact_dedup": exact_dedup.op12_exact_dedup,
    "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": substring_dedup.ORACLE_SQL,
    "op6_chat_format": chat_format.ORACLE_SQL,
    "op7_minhash_dedup": minhash_dedup.ORACLE_SQL,
    "op11_phrases": phrases.ORACLE_SQL,
    "op12_exact_dedup": exact_dedup.ORACLE_SQL,
    "op13_merkle_manifest": merkle_manifest.ORACLE_SQL,
}
