"""RANGE partitions and dictionary codes."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaline.session import scratch

PART = "__part"


def range_part(column: Column, bounds: list) -> Column:
    """Number of the range: rows below bounds[0] are 0, and so on; null goes to the first."""
    out = F.lit(0)
    for b in bounds:
        out = out + F.coalesce(column >= F.lit(b), F.lit(False)).cast("int")
    return out


def write_ranges(df: DataFrame, path: str, column: str, bounds: list) -> None:
    """Parquet in one folder per range."""
    df.withColumn(PART, range_part(F.col(column), bounds)).write.partitionBy(PART).parquet(path)


def read_ranges(spark: SparkSession, path: str, column: str, bounds: list, low=None, high=None) -> DataFrame:
    """Rows with low <= column < high; folders outside the bounds are never listed for reading."""
    df = spark.read.parquet(path)
    if low is not None:
        df = df.where((F.col(PART) >= bisect_right(bounds, low)) & (F.col(column) >= F.lit(low)))
    if high is not None:
        df = df.where((F.col(PART) <= bisect_right(bounds, high)) & (F.col(column) < F.lit(high)))
    return df.drop(PART)


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): codes from 0 in the order of values.

    Values are dealt by ranges and numbered within their part; a part's first code is the sum of those before it, so no
    task holds the whole dictionary.  The parts are written first, as ranges are drawn anew in each run.
    """
    path = scratch(df.sparkSession)
    values = df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    values.repartitionByRange("value").sortWithinPartitions("value").select("value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("nth")).write.parquet(path)
    placed = df.sparkSession.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    starts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "part").select("value", (F.col("start") + F.col("nth")).cast("int").alias("code"))


def dict_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the dictionary code of a column; null stays null."""
    codes = dictionary(df, column)
    return df.join(codes, df[column] == codes["value"], "left").drop("value").withColumnRenamed("code", name)
