"""Registered queries: one per operator of the survey inventory, each with its
DuckDB oracle SQL when the operator is expressible in SQL.

Every query reads whole tables (or data Spark derives from them).  Scores are
rounded to 6 decimals in the output; ranks use the score rounded to 9 decimals
with the item id as tie-break, in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


def _load():
    # Importing the modules fills the registry.
    from subjex.plans import (q_classify, q_dense, q_lexical, q_models, q_records, q_text,  # noqa: F401
                              q_io)  # noqa: F401
