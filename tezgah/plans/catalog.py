"""All queries of the core, and their SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tezgah.plans import analysis, records, retrieval, streams


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return retrieval.QUERIES | analysis.QUERIES | records.QUERIES | streams.QUERIES


def oracle_sql() -> dict[str, str]:
    return retrieval.SQL | analysis.SQL | records.SQL | streams.SQL
