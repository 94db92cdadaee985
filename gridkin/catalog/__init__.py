"""The registered queries and, where SQL can say it, their twins for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridkin.catalog import flows, pairs, runs, sequences, sets, signatures

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (sets, flows, signatures, pairs, sequences, runs)


def all_queries() -> dict[str, Query]:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
