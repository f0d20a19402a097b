"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import importlib

#: query name -> module with ``query(spark, sf_dir)`` and, where SQL can express it, ``SQL``.
MODULES = {
    "op1_substring_dedup": "substring",
    "op2_main_text": "htmltext",
    "op3_secret_scan": "secrets",
    "op4_decontamination": "decontaminate",
    "op5_packing": "packing",
    "op6_url_filter": "urlfilter",
    "op7_near_duplicates": "neardup",
    "op8_warc": "warc",
    "op9_licence_scan": "licences",
    "op10_quality_rules": "quality",
    "op11_importance_resampling": "resample",
    "op12_embedding_whitening": "whitening",
    "op13_token_counts": "tokencounts",
}


def _modules():
    return {name: importlib.import_module(f"loomcast.llm.{m}") for name, m in MODULES.items()}


def queries() -> dict:
    return {name: m.query for name, m in _modules().items()}


def oracle_sql() -> dict:
    return {name: m.SQL for name, m in _modules().items() if getattr(m, "SQL", None)}
