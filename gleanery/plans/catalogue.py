"""The engine's own queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from gleanery.plans.registry import ORACLE_SQL, QUERIES

for _name in ("reports", "audits", "extraction", "structured", "discovery", "streams", "runs"):
    import_module(f"gleanery.plans.{_name}")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["domains_summary"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
