"""The queries by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; without SQL where SQL can't express it."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


from . import content, guards, notices, queue, records, relational, rulesets, statement, statistical, streams, texts  # noqa: E402,F401
