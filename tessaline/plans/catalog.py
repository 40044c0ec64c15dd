"""Typed tables over the driver's Parquet: exact money, calendar dates, declared keys."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY, DAY = "decimal(12,2)", "date"
CASTS = {
    "region": {}, "nation": {}, "events": {},
    "customer": {"c_acctbal": MONEY}, "supplier": {"s_acctbal": MONEY}, "part": {"p_retailprice": MONEY},
    "orders": {"o_totalprice": MONEY, "o_orderdate": DAY},
    "lineitem": {"l_quantity": MONEY, "l_extendedprice": MONEY, "l_discount": MONEY, "l_tax": MONEY, "l_shipdate": DAY},
}
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"]}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One typed table; casts are projections, so pruning and pushdown reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast(CASTS[name][c]).alias(c) if c in CASTS[name] else F.col(c) for c in df.columns])


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of the typed tables, for SQL."""
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


_TABLE = re.compile(r"\b(" + "|".join(CASTS) + r")\b")


def tables_in(sql: str) -> list[str]:
    return list(dict.fromkeys(_TABLE.findall(sql)))


def duckdb_sql(sql: str) -> str:
    """The same statement over typed versions of the raw views, for an independent engine."""
    typed = []
    for name in tables_in(sql):
        casts = ", ".join(f"CAST({c} AS {kind.upper()}) AS {c}" for c, kind in CASTS[name].items())
        typed.append(f"typed_{name} AS (SELECT * {f'REPLACE ({casts}) ' if casts else ''}FROM {name})")
    body = _TABLE.sub(r"typed_\1", sql).strip()
    if not typed:
        return body
    head = "WITH " + ", ".join(typed)
    return f"{head}, {body[5:]}" if body[:5].upper() == "WITH " else f"{head} {body}"
