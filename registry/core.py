"""Registration of queries and composition of the checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
# SQL of the derived tables by name; see ``registry.tables``.
TABLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: str = "") -> Callable[[Query], Query]:
    """Register a query; ``tables`` names the derived tables its SQL reads."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_tables(sql, tables)
        return function

    return register


def with_tables(sql: str, tables: str) -> str:
    """Put the definitions of ``tables``, and of those they need, in front of ``sql``."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name in needed:
            return
        for other in TABLE_SQL:
            if f"{{{other}}}" in TABLE_SQL[name]:
                add(other)
        needed.append(name)

    for name in tables.split():
        add(name)
    bodies = []
    for name in needed:
        body = TABLE_SQL[name]
        for other in TABLE_SQL:
            body = body.replace(f"{{{other}}}", other)
        bodies.append(f"{name} AS ({body})")
    return (f"WITH {', '.join(bodies)} " if bodies else "") + sql


def money_sum(x: str) -> str:
    return f"coalesce(CAST(sum(CAST({x} AS DECIMAL(18,4))) AS DOUBLE), 0)"


def money_avg(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,4))) AS DOUBLE) / nullif(count({x}), 0)"


def score_avg(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,9))) AS DOUBLE) / nullif(count({x}), 0)"


def count(x: str = "*") -> str:
    return f"CAST(count({x}) AS BIGINT)"
