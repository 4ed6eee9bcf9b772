"""All queries of the core library, collected from their modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyreel.plans import integrity, lexicon, retrieval, timeline

MODULES = (retrieval, lexicon, timeline, integrity)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {k: s for m in MODULES for k, s in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that shows the engine."""
    return retrieval.zscore_fusion(spark, sf_dir)
