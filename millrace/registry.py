"""All registered queries, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import analytics_queries, catalog_queries, edge_queries, page_queries, source_queries, stream_queries

Query = Callable[[SparkSession, str], DataFrame]
FAMILIES = (catalog_queries, analytics_queries, page_queries, source_queries, stream_queries, edge_queries)


def queries() -> dict[str, Query]:
    return {name: query for family in FAMILIES for name, (query, _) in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, (_, sql) in family.QUERIES.items() if sql}
