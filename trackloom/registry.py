"""All queries of the engine and their DuckDB oracles; ``query`` registers one."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Which rows of the operator inventory a query covers.
COVERS: dict[str, str] = {}


MODULES = ["accuracy", "filters", "joins", "aggregates", "windows", "scalars", "events", "retrieval", "tracking", "sources", "formats", "places", "lifecycles", "masks", "cases", "exchange"]


def query(covers: str, sql: str | None = None):
    """Registers ``f(spark, sf_dir)`` under its name, with the inventory rows it covers and the SQL it must agree with."""

    def add(f):
        QUERIES[f.__name__], COVERS[f.__name__] = f, covers
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"trackloom.plans.{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["clear_mot_by_sequence"](spark, sf_dir)
