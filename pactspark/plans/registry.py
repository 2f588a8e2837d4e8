"""Registered queries: a function of (session, table folder) and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from pactspark.plans import contract_queries, document_queries, index_queries, judging_queries, listing_queries, rule_queries, storage_queries, stream_queries, table_queries  # noqa: F401
