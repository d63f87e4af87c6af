"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from lumen.llm import ball_kmeans, byte_bpe, circulant_minhash, decontaminate, fill_middle, language_id, license_scan, ngram_jaccard, quality_rules, secret_scan, substring_dedup, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.query,
        "op2_substring_dedup": substring_dedup.query,
        "op3_language_id": language_id.query,
        "op4_ngram_jaccard": ngram_jaccard.query,
        "op5_license_scan": license_scan.query,
        "op6_secret_scan": secret_scan.query,
        "op7_toxicity": toxicity.query,
        "op8_byte_bpe": byte_bpe.query,
        "op9_decontaminate": decontaminate.query,
        "op10_quality_rules": quality_rules.query,
        "op11_circulant_minhash": circulant_minhash.query,
        "op12_fill_middle": fill_middle.query,
        "op13_ball_kmeans": ball_kmeans.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": substring_dedup.ORACLE,
        "op4_ngram_jaccard": ngram_jaccard.ORACLE,
        "op11_circulant_minhash": circulant_minhash.ORACLE,
        "op12_fill_middle": fill_middle.ORACLE,
        "op13_ball_kmeans": ball_kmeans.ORACLE,
    }
