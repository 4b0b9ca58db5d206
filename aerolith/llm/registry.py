"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from aerolith.llm import bpe, chat, decontam, lexical, lm, neardup, quality, repair, secrets, store, substring, suffix, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.query,
        "op2_suffix_dedup": suffix.query,
        "op3_quality_rules": quality.query,
        "op4_near_duplicates": neardup.query,
        "op5_substring_dedup": substring.query,
        "op6_byte_bpe": bpe.query,
        "op7_decontaminate": decontam.query,
        "op8_language_model": lm.query,
        "op9_chat_format": chat.query,
        "op10_token_store": store.query,
        "op11_lexical_search": lexical.query,
        "op12_secret_scan": secrets.query,
        "op13_conversation_repair": repair.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality.oracle(), "op4_near_duplicates": neardup.oracle(), "op5_substring_dedup": substring.oracle(), "op9_chat_format": chat.oracle(), "op11_lexical_search": lexical.oracle(), "op13_conversation_repair": repair.oracle()}
