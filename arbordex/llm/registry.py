"""Queries and oracle SQL of the operators in this subpackage."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["exact_dedup", "mixing", "secrets", "warc", "knn", "toxicity", "quality", "packing", "jaccard", "substrings"]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in import_module(f"arbordex.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in import_module(f"arbordex.llm.{m}").ORACLE.items()}
