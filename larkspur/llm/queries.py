"""Queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from importlib import import_module

_OPERATORS = {
    "op1_pii": "pii",
    "op2_bpe": "bpe",
    "op3_toxicity": "toxicity",
    "op4_substrings": "substrings",
    "op5_decontaminate": "decontaminate",
    "op6_hostgraph": "hostgraph",
    "op7_sharding": "sharding",
    "op8_neardup": "neardup",
    "op9_secrets": "secrets",
    "op10_jaccard": "jaccard",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {}
