"""All registered queries and the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under ``name``, with its SQL where there is one."""

    def add(function: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


def load() -> None:
    for module in ("encoding", "profiling", "images", "texts", "metrics", "relational", "spatial", "learning", "simulation", "incremental", "scanning", "selection"):
        importlib.import_module(f"larkspur.plans.{module}")
