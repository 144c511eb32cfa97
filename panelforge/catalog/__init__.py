"""Registered queries of the research operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelforge.catalog import decisions, frames, statistics

FLAGSHIP = "P07_neutral_book_daily"
_PARTS = [frames, statistics, decisions]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in _PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in _PARTS for k, s in part.SQL.items()}
