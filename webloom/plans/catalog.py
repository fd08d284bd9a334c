"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom.plans import content_queries, coverage_queries, domain_queries, extract_queries, gate_queries, more_queries, page_queries, policy_queries, record_queries, region_queries, structure_queries, stream_queries, url_queries

MODULES = (url_queries, page_queries, extract_queries, domain_queries, policy_queries, content_queries, stream_queries, coverage_queries, more_queries, region_queries, structure_queries, gate_queries, record_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL by the name of the query."""
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
