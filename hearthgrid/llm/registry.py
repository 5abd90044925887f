"""Registered corpus queries ``opN_<name>`` and their check SQL, gathered from the operator modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("suffix_dedup", "prefix_trie", "nearest_vectors", "vector_codes", "token_counts", "fingerprints", "sharding", "secrets", "decontamination", "toxicity", "quality", "neardedup", "packing")


def _modules():
    return [importlib.import_module(f"hearthgrid.llm.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.QUERY: m.query for m in _modules()}


def oracles() -> dict[str, str]:
    return {m.QUERY: m.ORACLE_SQL for m in _modules() if m.ORACLE_SQL is not None}
