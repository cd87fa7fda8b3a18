"""Named queries with their DuckDB oracle.

``@query(sql)`` registers a function (spark, sf_dir) -> DataFrame under its own name. The SQL may use the market views of
``tessaro.plans.market`` by name; their definitions are put before it as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """A named piece of SQL that oracles and later views may use."""
    VIEWS[name] = sql.strip()


def needed(sql: str) -> list[str]:
    """The views that sql uses, in order of their definition."""
    wanted, todo = set(), [sql]
    while todo:
        text = todo.pop()
        new = {v for v in VIEWS if v not in wanted and re.search(rf"\b{v}\b", text)}
        wanted |= new
        todo += [VIEWS[v] for v in new]
    return [v for v in VIEWS if v in wanted]


def with_views(sql: str) -> str:
    body = sql.strip()
    ctes = [f"{v} AS (\n{VIEWS[v]}\n)" for v in needed(body)]
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register
