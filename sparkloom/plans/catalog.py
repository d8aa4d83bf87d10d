"""All queries of the core with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import context_queries, relational_queries, retrieval_queries, text_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**retrieval_queries.QUERIES, **relational_queries.QUERIES, **text_queries.QUERIES, **context_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**retrieval_queries.SQL, **relational_queries.SQL, **text_queries.SQL, **context_queries.SQL}
