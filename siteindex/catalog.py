"""All queries of the reference's operators, by id and noun, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import crawl, documents, metrics, scalars, site  # noqa: F401  they fill the registry
from .plans.registry import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.flagship(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
