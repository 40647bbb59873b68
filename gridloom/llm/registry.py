"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query -> module that defines it (and, where SQL can express it, ORACLE).
MODULES = {
    "op1_mix_sources": "mixing",
    "op2_jaccard_join": "jaccard",
    "op3_format_chat": "chat",
    "op4_extract_html": "html_text",
    "op5_pack_sequences": "packing",
    "op6_suffix_dedup": "suffix_dedup",
    "op7_secret_scan": "secrets",
    "op8_exact_dedup": "exact_dedup",
    "op9_quality_rules": "quality",
    "op10_token_files": "token_files",
    "op11_vector_codes": "vector_codes",
    "op12_repair_chats": "chat_repair",
    "op13_language_id": "language_id",
}


def queries() -> dict:
    return {name: getattr(import_module(f"gridloom.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"gridloom.llm.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
