"""Connected components by alternating large-star and small-star steps, on DataFrames.

Every step is a grouped minimum and a join back on the node, so no neighbour
list is gathered; a node with a large share of the links gets its minimum by
broadcast (`spread_join`), so no task receives all of them.  Before the first step each task shrinks its own links to
stars with a union-find.  State between steps goes to the shared checkpoint
folder as Parquet: a checkpoint would hand on its plan's constraints, which
grow with every step.  Only one count and one checksum reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import spread_join, stored


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the links a-b, without the roots themselves."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hooking to the smaller root, then pointer jumping
        rx, ry = root[x], root[y]
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for x in batches:
        a, b = np.concatenate([a, x.column(0).to_numpy()]), np.concatenate([b, x.column(1).to_numpy()])
        if len(a) > 2_000_000:
            a, b = local_roots(a, b)
    if len(a):
        a, b = local_roots(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])


def with_least(links: DataFrame, least: Column) -> DataFrame:
    """links (u, v) with m, what `least` gives for the links of u; links are stored."""
    facts = stored(links.groupBy("u").agg(least.alias("m"), F.count(F.lit(1)).alias("n")))
    return spread_join(links, facts, ["u"], "n").drop("n")


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node that has a link, and the smallest node it reaches."""
    stars = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").mapInArrow(_contract, "u long, v long")
    stars, before = stored(stars.distinct()), None  # u > v throughout
    while True:
        size = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (size["n"], size["h"]) == before or not size["n"]:
            break
        before = (size["n"], size["h"])
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(with_least(both, F.least(F.min("v"), F.first("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        joined = with_least(large, F.min("v"))
        small = joined.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        stars = stored(small)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
