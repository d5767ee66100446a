"""The queries of this subpackage, with SQL where DuckDB can express them."""

from __future__ import annotations

from . import decontamination, fingerprints, hard_negatives, html_text, mixing, ngram_join, phrases, pii, quality, resampling, suffix_dedup, token_counts, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_html_extraction": html_text.op3_html_extraction,
    "op4_mixing": mixing.op4_mixing,
    "op5_importance_resampling": resampling.op5_importance_resampling,
    "op6_warc": warc.op6_warc,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_phrases": phrases.op11_phrases,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_fingerprints": fingerprints.op13_fingerprints,
}

ORACLES = {
    "op4_mixing": mixing.ORACLE_SQL,
    "op6_warc": warc.ORACLE_SQL,
    "op7_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op8_ngram_join": ngram_join.ORACLE_SQL,
    "op10_quality_rules": quality.ORACLE_SQL,
    "op11_phrases": phrases.ORACLE_SQL,
    "op12_hard_negatives": hard_negatives.ORACLE_SQL,
}
