"""Driver cases: each pairs a Spark query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def case(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate case {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    import importlib

    for mod in MODULES:
        importlib.import_module(f"corpusloom.cases.{mod}")


MODULES = ["store_cases", "chunk_cases", "record_cases", "graph_cases", "alias_cases", "retrieval_cases", "context_cases", "chat_cases", "eval_cases", "io_cases"]
