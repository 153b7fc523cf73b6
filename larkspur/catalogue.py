"""Every registered query of the relational engine with its DuckDB counterpart."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import dataframe, engine, relational, tpch
from .sources.tables import TABLES
from .sources.views import DERIVED, expand, run_sql

SQL = relational.QUERIES | tpch.QUERIES


def _tables(sql: str) -> tuple[str, ...]:
    text = sql
    for name, derived in DERIVED.items():
        text = text.replace("{" + name + "}", derived)
    return tuple(t for t in TABLES if re.search(rf"\b{t}\b", text))


def _sql_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, sql, _tables(sql))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _sql_query(sql) for name, sql in SQL.items()} | dataframe.QUERIES | engine.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: expand(sql, "duckdb") for name, sql in SQL.items()} | dataframe.ORACLE_SQL | engine.ORACLE_SQL
