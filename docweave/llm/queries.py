"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

import importlib
import importlib.util

#: Query name, module, function.
TABLE = [
    ("op1_pack_sequences", "packing", "op1"),
    ("op2_license_scan", "licenses", "op2"),
    ("op3_exact_topk", "topk", "op3"),
    ("op4_decontaminate", "decontam", "op4"),
    ("op5_substring_dedup", "substrings", "op5"),
    ("op6_ngram_jaccard", "jaccard", "op6"),
    ("op7_secret_scan", "secrets", "op7"),
    ("op8_quality", "quality", "op8"),
    ("op9_pii", "pii", "op9"),
    ("op10_html_text", "html", "op10"),
]


def _built() -> list:
    return [row for row in TABLE if importlib.util.find_spec(f"{__package__}.{row[1]}")]


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), f) for name, module, f in _built()}


def oracle_sql() -> dict:
    out = {}
    for name, module, f in _built():
        if sql := getattr(importlib.import_module(f"{__package__}.{module}"), "SQL", {}).get(f):
            out[name] = sql
    return out
