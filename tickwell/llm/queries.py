"""Registered queries of this subpackage: one for each numbered operator."""

from __future__ import annotations

from tickwell.llm import conversations, fingerprints, html_text, jaccard_join, language, mixing, packing, pseudo_likelihood, quality, repetition, runs, topk, toxicity

QUERIES = {
    "op1_ngram_jaccard_join": jaccard_join.query,
    "op2_fingerprints": fingerprints.query,
    "op3_mixing": mixing.query,
    "op4_language_id": language.query,
    "op5_quality": quality.query,
    "op6_packing": packing.query,
    "op7_html_text": html_text.query,
    "op8_lm_scoring": pseudo_likelihood.query,
    "op9_toxicity": toxicity.query,
    "op10_exact_top_k": topk.query,
    "op11_quality_rules": repetition.query,
    "op12_conversation_repair": conversations.query,
    "op13_periodic_runs": runs.query,
}
ORACLE_SQL = {
    "op3_mixing": mixing.SQL,
    "op1_ngram_jaccard_join": jaccard_join.SQL,
    "op10_exact_top_k": topk.SQL,
    "op11_quality_rules": repetition.SQL,
    "op12_conversation_repair": conversations.SQL,
    "op13_periodic_runs": runs.SQL,
}
