"""All registered queries of the core."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("texts", "corpora", "learning", "transfers", "generated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in MODULES for f in import_module(f"tessella.queries.{m}").QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"tessella.queries.{m}").SQL.items()}
