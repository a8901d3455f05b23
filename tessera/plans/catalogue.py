"""All queries over the driver's tables, each with the SQL that DuckDB must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalogue_changes, catalogue_more, catalogue_reports, catalogue_store, catalogue_text

Query = Callable[[SparkSession, str], DataFrame]
PARTS = (catalogue_reports, catalogue_text, catalogue_changes, catalogue_more, catalogue_store)


def queries() -> dict[str, Query]:
    return {k: f for p in PARTS for k, f in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in PARTS for k, s in p.ORACLES.items()}
