"""Grouping helpers beyond `groupBy().agg()`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_by_key(df: DataFrame, keys: list[str], unique_key: str, aggregates: list[Column]) -> DataFrame:
    """GROUP BY keys where `unique_key` determines the others: only it is hashed, the rest ride along."""
    rest = [k for k in keys if k != unique_key]
    return df.groupBy(unique_key).agg(*[F.first(k).alias(k) for k in rest], *aggregates)


def salted(df: DataFrame, keys: list[str], partial: dict[str, Column], final: dict[str, Column], salts: int = 64) -> DataFrame:
    """Two-step aggregation for aggregates that Spark can't combine on the map side: a hot key is spread over salts."""
    spread = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    return spread.groupBy(*keys, "__salt").agg(*[c.alias(n) for n, c in partial.items()]).groupBy(*keys).agg(*[c.alias(n) for n, c in final.items()])


def having(grouped: DataFrame, condition: Column) -> DataFrame:
    return grouped.where(condition)


def top(df: DataFrame, order: list[Column], n: int, offset: int = 0) -> DataFrame:
    """ORDER BY with LIMIT and OFFSET; without an offset Spark keeps n rows per task."""
    out = df.orderBy(*order)
    return out.offset(offset).limit(n) if offset else out.limit(n)
