"""Joins as the engine's users name them; strategy is left to the optimiser and adaptive execution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"inner": "inner", "cross": "cross", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], kind: str = "inner", residual: Column | None = None) -> DataFrame:
    """Equality keys plus a residual condition that belongs to ON: for outer joins it decides matching, not filtering."""
    on = [left[a] == right[b] for a, b in keys] + ([residual] if residual is not None else [])
    return left.join(right, reduce(lambda x, y: x & y, on), KINDS[kind]) if on else left.crossJoin(right)


def theta_join(left: DataFrame, right: DataFrame, on: Column, kind: str = "inner") -> DataFrame:
    """Any condition; without an equality in it Spark compares every pair of rows."""
    return left.join(right, on, KINDS[kind])


def exists(left: DataFrame, right: DataFrame, on: Column, negate: bool = False) -> DataFrame:
    return left.join(right, on, "left_anti" if negate else "left_semi")


def in_subquery(left: DataFrame, column: str, right: DataFrame, negate: bool = False) -> DataFrame:
    """IN or NOT IN over the one column of `right`; a null there empties NOT IN, and a null on the left never passes it."""
    values = right.select(F.col(right.columns[0]).alias("__value"))
    if not negate:
        return left.join(values, left[column] == F.col("__value"), "left_semi")
    facts = values.agg(F.count(F.lit(1)).alias("__n"), F.count(F.when(F.col("__value").isNull(), 1)).alias("__nulls"))
    kept = left.join(values.where("__value IS NOT NULL"), left[column] == F.col("__value"), "left_anti").crossJoin(F.broadcast(facts))  # one row
    return kept.where((F.col("__n") == 0) | ((F.col("__nulls") == 0) & F.col(column).isNotNull())).drop("__n", "__nulls")


def others_in_group(df: DataFrame, group: str, member: str, late: Column, name: str = "others") -> DataFrame:
    """One pass for EXISTS / NOT EXISTS pairs of a table with itself.

    Adds to every row whether its group holds another member (`others`) and another member with a `late` row
    (`others_late`): smallest and largest members of the group decide, so the table is grouped once.
    """
    facts = df.groupBy(group).agg(F.min(member).alias("__lo"), F.max(member).alias("__hi"), F.min(F.when(late, F.col(member))).alias("__llo"), F.max(F.when(late, F.col(member))).alias("__lhi"))
    joined = df.join(facts.withColumnRenamed(group, "__g"), F.col(group) == F.col("__g"))
    differs = lambda lo, hi: F.coalesce((F.col(lo) != F.col(member)) | (F.col(hi) != F.col(member)), F.lit(False))
    return joined.withColumn(name, differs("__lo", "__hi")).withColumn(f"{name}_late", differs("__llo", "__lhi")).drop("__g", "__lo", "__hi", "__llo", "__lhi")
