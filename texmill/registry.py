"""Names of the queries, the functions that build them and the DuckDB SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from texmill.plans import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function (spark, sf_dir) under its own name; oracle may use {names} of tables and derived inputs."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = corpus.expanded(oracle)
        return f

    return put


for _part in ("evaluation", "markdown", "analytics", "layout", "regions", "model", "equations", "host", "stream"):
    importlib.import_module(f"texmill.plans.{_part}")
