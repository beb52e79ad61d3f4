"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillspark.llm import contracts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: getattr(contracts, name) for name in contracts.NAMES
}
ORACLE_SQL: dict[str, str] = dict(contracts.SQL)
