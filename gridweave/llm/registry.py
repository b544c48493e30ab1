"""The registered queries of this package and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = ["shards", "licences", "bpe", "tokenfile", "decontaminate", "language", "quality", "tokencount", "near", "wrappers",
           "fingerprints", "clusters", "phrases"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load_all() -> None:
    import importlib
    for name in MODULES:
        importlib.import_module(f"gridweave.llm.{name}")
