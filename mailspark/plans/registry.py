"""All registered queries of the library and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mailspark.plans import case_oracle, case_queries, io_oracle, io_queries, message_oracle, message_queries
from mailspark.plans.adapters import with_views


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return case_queries.QUERIES | message_queries.QUERIES | io_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in (case_oracle.SQL | message_oracle.SQL | io_oracle.SQL).items()}
