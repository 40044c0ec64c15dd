"""Delimited files with the options of LOAD DATA."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LoadError(ValueError):
    pass


def load_delimited(spark: SparkSession, path: str, schema: T.StructType, *, fields: str = "\t", enclosed: str = "", escaped: str = "\\", lines: str = "\n", starting: str = "", ignore: int = 0, null: str = "\\N", strict: bool = True) -> DataFrame:
    """Typed rows of a file.

    Fields are read as text and cast, so that a bad or overflowing value is an error in strict mode and null
    otherwise (a missing field and an empty one outside quotes are null); a null in a NOT NULL column is an error in strict mode.  `ignore` skips
    first lines of each file, `starting` is a prefix that a line must have and loses, a trailing separator adds no column.
    """
    names = [f.name for f in schema]
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "__tail"]])
    options = {"sep": fields, "quote": enclosed or "\u0000", "escape": escaped or "\u0000", "nullValue": null, "emptyValue": "", "mode": "PERMISSIVE"}
    if enclosed and not starting and lines in ("\n", "\r\n", "\r") and ignore <= 1:  # line breaks may stand inside enclosed fields
        rows = spark.read.schema(text).options(**options, multiLine=True, header=bool(ignore), enforceSchema=True).csv(path)
    else:
        raw = spark.read.option("lineSep", lines).text(path).select("value", F.col("_metadata.file_path").alias("__file"), (F.col("_metadata.file_block_start") == 0).alias("__head"), F.monotonically_increasing_id().alias("__at"))
        if ignore:  # of each file: its first lines are the first of the split that starts it
            first = raw.where("__head").groupBy("__file").agg(F.min("__at").alias("__first"))
            raw = raw.join(first, "__file", "left").where(~(F.col("__head") & (F.col("__at") < F.col("__first") + ignore)))
        if starting:
            raw = raw.where(F.contains("value", F.lit(starting))).withColumn("value", F.expr(f"substring(value, locate('{starting}', value) + {len(starting)})"))
        rows = raw.select(F.from_csv("value", text.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*")
    out = []
    for f in schema:
        cast = F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})") if not isinstance(f.dataType, T.StringType) else F.col(f.name)
        if strict:
            bad = cast.isNull() & F.col(f.name).isNotNull()
            cast = F.when(bad, F.raise_error(F.concat(F.lit(f"bad value for {f.name}: "), F.col(f.name))).cast(f.dataType)).otherwise(cast)
            if not f.nullable:
                cast = F.when(F.col(f.name).isNull(), F.raise_error(F.lit(f"null for {f.name}")).cast(f.dataType)).otherwise(cast)
        out.append(cast.alias(f.name))
    return rows.select(*out)


def write_delimited(df: DataFrame, path: str, fields: str = "|", null: str = "\\N") -> None:
    df.write.option("sep", fields).option("nullValue", null).option("emptyValue", "").csv(path)


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Key values held by several rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
