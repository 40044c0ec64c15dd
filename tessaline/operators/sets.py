"""UNION with the strict rule that both sides agree in number and types of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _checked(a: DataFrame, b: DataFrame) -> DataFrame:
    kinds = [(x.dataType, y.dataType) for x, y in zip(a.schema, b.schema)]
    if len(a.columns) != len(b.columns) or any(x != y for x, y in kinds):
        raise TypeError("both sides of a union need the same number and types of columns; cast them first")
    return a.union(b)


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return _checked(a, b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return _checked(a, b).distinct()
