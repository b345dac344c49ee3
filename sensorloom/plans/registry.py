"""The registry of runnable queries and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _expand(sql: str) -> str:
    """Write ``r6(x)`` out as a rounding that has one zero, as Spark's rounding does."""
    mark = "r6("
    while mark in sql:
        start = sql.index(mark)
        depth, i = 1, start + len(mark)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        inner = sql[start + len(mark) : i - 1]
        sql = f"{sql[:start]}(round({inner}, 6) + 0.0){sql[i:]}"
    return sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator id, with its oracle where SQL can state one."""

    def register(make: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = make
        if sql is not None:
            ORACLES[name] = _expand(sql).strip()
        return make

    return register


def r6(value: Column | str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6)
