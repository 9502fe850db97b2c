"""All registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import behavior_queries, book_queries, model_queries, relational_queries, research_queries, science_queries, tape_queries

MODULES = (tape_queries, book_queries, relational_queries, model_queries, behavior_queries, research_queries, science_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
