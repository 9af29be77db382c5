"""The named queries of the library and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame

QUERIES: dict[str, Callable[..., DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) as a query, with the DuckDB SQL of the same rows where there is one."""

    def keep(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return keep


for _module in ("dedupe", "cleaning", "structure", "features", "machine_text", "chunks", "profiles", "scores", "learning", "verdicts", "store"):
    importlib.import_module(f"inkwell.plans.{_module}")
