"""The corpus operators' queries and their SQL, by name."""

from __future__ import annotations

from . import (
    language_id,
    line_dedup,
    lm_scoring,
    ngram_join,
    packing,
    quality_classifier,
    quality_rules,
    secret_scans,
    sentencepiece_codec,
    substring_dedup,
    topk_search,
    vector_codes,
    whitening,
)

QUERIES = {
    "op1_exact_topk_search": topk_search.op1_exact_topk_search,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_sentencepiece": sentencepiece_codec.op5_sentencepiece,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_secret_scans": secret_scans.op7_secret_scans,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_language_id": language_id.op9_language_id,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_vector_code_compression": vector_codes.op12_vector_code_compression,
    "op13_line_dedup": line_dedup.op13_line_dedup,
}
ORACLES = {
    "op1_exact_topk_search": topk_search.ORACLE,
    "op2_quality_rules": quality_rules.ORACLE,
    "op3_ngram_join": ngram_join.ORACLE,
    "op6_substring_dedup": substring_dedup.ORACLE,
    "op12_vector_code_compression": vector_codes.ORACLE,
    "op13_line_dedup": line_dedup.ORACLE,
}
