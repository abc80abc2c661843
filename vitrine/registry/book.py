"""Where the registered queries put themselves, each with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.registry.tables import TABLES_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str) -> Callable:
    """Register a function of Tables as a query, and its check."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        ORACLES[name] = with_tables(sql)
        return build

    return register


def query_like(name: str, other: str) -> Callable:
    """Register a query that must give what another one gives."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        made = query(name, "")(build)
        ORACLES[name] = ORACLES[other]
        return made

    return register


def with_tables(sql: str) -> str:
    """Put the catalogue tables a statement names in front of it as common table expressions."""
    named = [text for name, text in TABLES_SQL.items() if re.search(rf"\b{name}\b", sql)]
    sql = sql.strip()
    if not named:
        return sql
    if sql.upper().startswith("WITH "):
        return "WITH " + ",\n".join(named) + ",\n" + sql[5:]
    return "WITH " + ",\n".join(named) + "\n" + sql


def rounded(frame: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return frame.withColumns({name: F.round(F.col(name), places) for name in columns})


def bigint(column: Column) -> Column:
    return column.cast("bigint")
