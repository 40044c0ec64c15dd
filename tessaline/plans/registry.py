"""The catalogue of relational queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessaline.plans import built, relational
from tessaline.plans.catalog import register, tables_in

FLAGSHIP = "q1_pricing_summary"


def run(spark: SparkSession, sf_dir: str, query: relational.Query) -> DataFrame:
    """One shared text over the typed tables that it names."""
    text = query.spark()
    register(spark, sf_dir, *tables_in(text))
    return spark.sql(text)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, relational.QUERIES[FLAGSHIP])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    shared = {name: (lambda spark, sf_dir, q=q: run(spark, sf_dir, q)) for name, q in relational.QUERIES.items()}
    return shared | built.BUILT


def oracle_sql() -> dict[str, str]:
    return {name: q.oracle() for name, q in relational.QUERIES.items()} | built.ORACLES
