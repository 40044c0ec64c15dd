"""Byte n-grams as integers, and a vectorised index over them."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


class KeyIndex:
    """Place of each key in `keys` (distinct uint64), or -1; a bucketed hash table probed by whole arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(2, len(keys))))) + 1)
        self.shift = np.uint64(64 - bits)
        home = ((keys * _MIX) >> self.shift).astype(np.int64)
        self.order = np.argsort(home, kind="stable").astype(np.int32)
        self.keys = np.append(keys[self.order], np.uint64(0))
        counts = np.bincount(home, minlength=1 << bits)
        self.start = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        self.longest = int(counts.max()) if len(keys) else 0
        self.order = np.append(self.order, np.int32(-1))
        self.size = len(keys)

    def find(self, q: np.ndarray) -> np.ndarray:
        home = ((q * _MIX) >> self.shift).astype(np.int64)
        at = self.start[home]
        hit = (self.keys[at] == q) & (at < self.size)
        out = np.where(hit, self.order[at], np.int32(-1))
        if self.longest > 1:
            left = np.flatnonzero(~hit & (self.start[home + 1] - at > 1))
            at, end, q = at[left], self.start[home[left] + 1], q[left]
            for _ in range(1, self.longest):
                at = at + 1
                live = at < end
                left, at, end, q = left[live], at[live], end[live], q[live]
                if not len(left):
                    break
                hit = self.keys[at] == q
                out[left[hit]] = self.order[at[hit]]
        return out


def padded_bytes(texts: list[bytes], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end, each after `pad` zero bytes; and the first byte's place of each, plus the end."""
    zeros = b"\0" * pad
    joined = np.frombuffer(b"".join([zeros + t for t in texts]), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return joined, np.concatenate([[0], np.cumsum(lengths + pad)]) + pad


def grams(joined: np.ndarray, n: int) -> np.ndarray:
    """At each place the n bytes that end there, as one integer (at most 8 bytes)."""
    out = joined.astype(np.uint64)
    wide = out.copy()
    for k in range(1, n):
        out[k:] |= wide[:-k] << np.uint64(8 * k)
    return out
