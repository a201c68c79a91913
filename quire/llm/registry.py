"""Query names of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: query -> module of this subpackage; modules with a constant ORACLE_SQL have an SQL form.
MODULES = {
    "op8_ngram_jaccard": "jaccard",
    "op5_embedding_neardup": "neardup",
    "op10_lm_score": "lm",
    "op1_quality_qda": "quality",
    "op6_language_id": "language",
    "op4_best_fit_packing": "packing",
    "op3_flac_media": "media",
    "op2_license_scan": "licenses",
    "op7_chat_format": "chat",
    "op9_source_mix": "mixing",
    "op11_substring_dedup": "substrings",
    "op13_phrase_mining": "phrases",
    "op12_embedding_whitening": "whitening",
}


def queries() -> dict:
    return {name: getattr(import_module(f"quire.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"quire.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
