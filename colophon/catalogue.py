"""Registry of the engine's queries and of the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import adapters, citations, matching, notes, records, references  # noqa: F401  they register their queries
from .plans.registry import QUERIES, SQL


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: keyword hits of all documents, merged by content with their provenance."""
    return QUERIES["candidate_upsert"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
