"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, conversations, fingerprints, importance, language_id, mixing, near_dedup, pii, quality, substring_dedup, toxicity, url_filter, vector_search

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_vector_search": vector_search.query,
    "op3_language_id": language_id.query,
    "op4_pii": pii.query,
    "op5_quality": quality.query,
    "op6_bpe": bpe.query,
    "op7_fingerprints": fingerprints.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_minhash_near_dedup": near_dedup.query,
    "op10_mixing": mixing.query,
    "op11_importance_resampling": importance.query,
    "op12_conversation_repair": conversations.query,
    "op13_url_filter": url_filter.query,
}

SQL: dict[str, str] = {
    "op4_pii": pii.oracle(),
    "op10_mixing": mixing.oracle(),
    "op11_importance_resampling": importance.oracle(),
    "op12_conversation_repair": conversations.oracle(),
    "op13_url_filter": url_filter.oracle(),
}
