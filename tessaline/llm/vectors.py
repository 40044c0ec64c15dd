"""What the two vector operators share: usable rows, classes of equal vectors, a bounded sample, centroids, Arrow packing.

Vectors of different lengths have no cosine, so everything here works length by
length: centroids are fitted for each length that the sample holds, and a
length that it doesn't hold is one cluster of its own.  Components are scaled
by a power of two before any product, so that very small or large ones neither
under- nor overflow; such a scaling changes no bit of a cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, PER_CLUSTER, MAX_CLUSTERS = 20_000, 16, 16_384  # the sample is at most the larger of the first and the product
LARGE = 1024  # clusters from which on they are fitted and found in two levels


def is_usable(vector: Column) -> Column:
    """No null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & is_usable(F.col("v")))


def class_hash(vector: Column) -> list[Column]:
    return [F.xxhash64(vector).alias("h1"), F.xxhash64(F.lit(11), vector).alias("h2")]


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows of it, their matrix) of a list column of doubles."""
    if not len(column):
        return
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == d)
        part = column if len(own) == len(column) else column.take(pa.array(own))
        yield d, own, np.asarray(part.flatten(), dtype=np.float64).reshape(len(own), d)


def balanced(x: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two to a largest component from 0.5 to 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = balanced(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of each row pair in double precision; equal rows give equal values wherever they stand."""
    q, x = balanced(q), balanced(x)
    return (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


def cluster_count(n: int, per: float) -> int:
    return max(1, min(MAX_CLUSTERS, math.ceil(n / per)))


def sample(rows: DataFrame, n: int, clusters: int) -> dict[int, np.ndarray]:
    """Unit vectors of each length, in id order: about max(SAMPLE, PER_CLUSTER * clusters) of n at most, drawn by a hash of the id."""
    limit = max(SAMPLE, PER_CLUSTER * clusters)
    drawn = F.pmod(F.xxhash64(F.lit("vector sample"), "id"), F.lit(1 << 30)) < int(min(1.0, limit / max(1, n)) * (1 << 30))
    got = rows.where(drawn).select("id", "v").toArrow()
    if not got.num_rows:
        got = rows.select("id", "v").limit(1).toArrow()
    got = got.combine_chunks().sort_by("id")
    return {d: unit(x) for d, _, x in by_length(got.column("v").combine_chunks())} if got.num_rows else {}


def kmeans(x: np.ndarray, k: int, rounds: int = 8, spherical: bool = True, seed: int = 5) -> np.ndarray:
    """k centroids of the rows of x (fewer, if x has fewer rows)."""
    k = max(1, min(k, len(x)))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = nearest(x, c, 1, spherical)[:, 0]
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, x[:, j], minlength=k) for j in range(x.shape[1])], 1)
        own = n > 0
        c[own] = total[own] / n[own, None]
        if spherical:
            norm = np.linalg.norm(c, axis=1, keepdims=True)
            c = np.where(norm > 0, c / np.maximum(norm, 1e-300), c)
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int, spherical: bool = True) -> np.ndarray:
    """The n nearest centroids of each row, nearest first, ties to the smaller number."""
    out = np.empty((len(x), min(n, len(c))), np.int64)
    for i in range(0, len(x), 4096):
        s = x[i : i + 4096] @ c.T
        if not spherical:
            s = 2 * s - (c * c).sum(axis=1)
        out[i : i + 4096] = np.argmax(s, axis=1)[:, None] if out.shape[1] == 1 else np.argsort(-s, axis=1, kind="stable")[:, : out.shape[1]]
    return out


class Clusters:
    """Centroids of each length, numbered through; beyond LARGE they are fitted and searched in two levels."""

    def __init__(self, samples: dict[int, np.ndarray], n: int, per: float):
        drawn = sum(map(len, samples.values()))
        self.centroids = {d: self.fit(x, cluster_count(round(n * len(x) / max(1, drawn)), per)) for d, x in samples.items()}
        sizes = [len(self.centroids[d]) for d in sorted(self.centroids)]
        self.base = dict(zip(sorted(self.centroids), np.cumsum([0, *sizes]).tolist()))
        self.count = sum(sizes)
        self.heads = {d: kmeans(c, math.isqrt(len(c)), 6) for d, c in self.centroids.items() if len(c) > LARGE}
        self.under = {d: [np.flatnonzero(own == i) for i in range(len(self.heads[d]))] for d in self.heads if (own := nearest(self.centroids[d], self.heads[d], 1)[:, 0]) is not None}

    @staticmethod
    def fit(x: np.ndarray, k: int) -> np.ndarray:
        if k <= LARGE or len(x) <= k:
            return kmeans(x, k)
        own = nearest(x, kmeans(x, math.isqrt(k)), 1)[:, 0]
        groups = [g for i in np.unique(own).tolist() if len(g := x[own == i])]
        return np.concatenate([kmeans(g, max(1, round(k * len(g) / len(x)))) for g in groups])

    def of(self, d: int) -> int:
        """Clusters of a length."""
        return len(self.centroids[d]) if d in self.centroids else 1

    def most(self) -> int:
        return max((len(c) for c in self.centroids.values()), default=1)

    def number(self, d: int, own: np.ndarray) -> np.ndarray:
        """Numbers through all lengths; a length without centroids has the number -d - 1."""
        return own + self.base[d] if d in self.centroids else np.full_like(own, -d - 1)

    def assign(self, d: int, x: np.ndarray, n: int) -> np.ndarray:
        """[row, n] nearest clusters of unit rows within their length (fewer columns, if it has fewer)."""
        if d not in self.centroids:
            return np.zeros((len(x), 1), np.int64)
        c = self.centroids[d]
        if d not in self.heads or 8 * n > len(c):
            return nearest(x, c, n)
        heads = nearest(x, self.heads[d], max(4, min(len(self.heads[d]), -(-4 * n * len(self.heads[d]) // len(c)))))
        out = np.empty((len(x), n), np.int64)
        for key in np.unique(heads, axis=0):
            own = np.flatnonzero((heads == key).all(axis=1))
            few = np.sort(np.concatenate([self.under[d][h] for h in key.tolist()]))
            out[own] = few[nearest(x[own], c[few], n)] if len(few) >= n else nearest(x[own], c, n)
        return out


def packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    size = x.shape[1] * x.itemsize
    if not len(x) or not size:
        return pa.array([b""] * len(x), pa.binary())
    offsets = np.arange(len(x) + 1, dtype=np.int64) * size
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)]).cast(pa.binary())


def unpacked(column: pa.Array | pa.ChunkedArray, dtype: type) -> np.ndarray:
    """The matrix of binary values of one length."""
    parts = []
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(c):
            at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]].view(dtype).reshape(len(c), -1))
    return np.concatenate(parts)


def runs(batches: Iterator[pa.RecordBatch], keys: int, limit: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of each run of equal values in the first `keys` columns of a sorted stream, in parts of about `limit` rows at most."""
    now, parts, held = None, [], 0
    for b in batches:
        if not b.num_rows:
            continue
        ks = [c.to_numpy(zero_copy_only=False) for c in b.columns[:keys]]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in ks], axis=0)) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            key = tuple(k[a].item() for k in ks)
            if parts and (key != now or held >= limit):
                yield now, pa.Table.from_batches(parts)
                parts, held = [], 0
            now = key
            parts.append(b.slice(a, z - a))
            held += z - a
    if parts:
        yield now, pa.Table.from_batches(parts)
