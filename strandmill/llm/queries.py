"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query name: module of this package, which has query(spark, sf_dir) and, where SQL can express it, ORACLE_SQL.
MODULES = {
    "op1_personal_data": "personal",
    "op10_language_model": "language_model",
    "op11_manifest": "merkle",
    "op12_urls": "urls",
    "op13_conversations": "conversations",
    "op2_byte_bpe": "tokenize",
    "op3_near_dedup": "near_dedup",
    "op4_language": "language",
    "op5_token_files": "token_files",
    "op6_mixing": "mixing",
    "op7_neighbours": "neighbours",
    "op8_exact_dedup": "exact_dedup",
    "op9_resample": "resample",
}


def queries() -> dict:
    return {name: import_module(f".{module}", __package__).query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f".{module}", __package__), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
