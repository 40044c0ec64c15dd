"""Best-fit packing of documents into fixed-capacity sequences (operator 1).

Sizes are integers of at most `capacity`, so the whole bin-packing instance is
its histogram: `capacity` counters, however many documents there are.  The
driver solves the histogram, never the documents:

1. Martello-Toth dominance: going down the sizes, a set {j}, {j, k} or
   {j, a, b} that dominates every other feasible set with j is fixed for as
   many copies as exist (see `dominating`).
2. The shrunk instance goes to best-fit decreasing, run on whole groups of
   equal bins at a time (`best_fit`), which gives the bins that the item-by-item
   rule gives.

The result is a list of (pattern, how often).  Documents find their place by
their rank among the items of their size: ranks come from a per-partition
running index plus a prefix sum of per-partition counts, so no size class is
ever gathered in one task, whatever its share of the rows.

Defined results: null and empty text is the lone end id; a document longer
than the capacity is cut so that only its first piece is shorter; repeated rows
are packed separately; an empty table gives no rows; rows with a null doc_id
are packed like others; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaline.llm.byte_bpe import byte_bpe
from tessaline.llm.common import batch, bound_batches, cut, tidy

CAPACITY = 1024

Pattern = tuple[tuple[int, int], ...]  # (size, copies), in the order of placing


def dominating(count: list[int], j: int, capacity: int) -> tuple[int, ...] | None:
    """Sizes to join one item j in a bin that dominates all other feasible bins with j, or None.

    `count` holds the free items besides that j.  A set F1 dominates F2 when F2's
    items can be split so that each part fits under a different item of F1.
    - nothing fits beside j: {j};
    - k fills the rest exactly: any other filling fits under k, so {j, k};
    - no two items fit beside j: the largest k that fits dominates every other one;
    - no three fit: a largest single k no smaller than the best pair dominates all pairs; a pair (a, b)
      that has the largest single as a, and the largest partner of a as b, dominates when no feasible
      pair has a second item above b.
    """
    room = capacity - j
    fits = [s for s in range(1, room + 1) if count[s]]
    if not fits:
        return ()
    largest = fits[-1]
    if largest == room:
        return (room,)
    least: list[int] = []
    for s in fits:
        least += [s] * min(count[s], 3 - len(least))
        if len(least) == 3:
            break
    if len(least) < 2 or least[0] + least[1] > room:
        return (largest,)
    if len(least) == 3 and sum(least) <= room:
        return None
    best, second = 0, 0  # over feasible pairs: largest sum, largest smaller item
    for a in fits:
        for b in reversed([b for b in fits if b <= min(a, room - a)]):
            if b < a or count[a] > 1:
                best, second = max(best, a + b), max(second, b)
                break
    if largest >= best:
        return (largest,)
    partner = max((b for b in fits if b <= room - largest and (b != largest or count[b] > 1)), default=0)
    return (largest, partner) if partner and partner >= second else None


def reduce_instance(count: list[int], capacity: int) -> Counter[Pattern]:
    """Fix dominating sets in place: what they use leaves `count`.  A set dominates for as long as its sizes last,
    for taking items away only takes rivals away."""
    fixed: Counter[Pattern] = Counter()
    for j in range(capacity, 0, -1):
        while count[j]:
            count[j] -= 1
            chosen = dominating(count, j, capacity)
            count[j] += 1
            if chosen is None:
                break
            need = Counter((j, *chosen))
            times = min(count[s] // n for s, n in need.items())
            for s, n in need.items():
                count[s] -= n * times
            fixed[tuple(sorted(need.items(), reverse=True))] += times
    return fixed


def best_fit(count: list[int], capacity: int) -> Counter[Pattern]:
    """Best-fit decreasing over a histogram; equal bins move as one group."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)  # by free room
    done: Counter[Pattern] = Counter()

    def put(pattern: Pattern, bins: int, room: int, size: int, copies: int) -> None:
        if bins:
            pattern = (*pattern, (size, copies)) if copies else pattern
            (done.update({pattern: bins}) if room == copies * size else open_bins[room - copies * size].append((pattern, bins)))

    for size in range(capacity, 0, -1):
        n = count[size]
        for room in range(size, capacity + 1):
            if not n:
                break
            per = room // size
            groups, open_bins[room] = open_bins[room], []
            for pattern, bins in groups:
                full = min(bins, n // per)
                rest = min(n - full * per, per - 1) if full < bins else 0
                put(pattern, full, room, size, per)
                put(pattern, 1 if rest else 0, room, size, rest)
                put(pattern, bins - full - (1 if rest else 0), room, size, 0)
                n -= full * per + rest
        per = capacity // size
        put((), n // per, capacity, size, per)
        put((), 1 if n % per else 0, capacity, size, n % per)
        count[size] = 0
    for groups in open_bins.values():
        for pattern, bins in groups:
            done[pattern] += bins
    return done


def solve(sizes: dict[int, int], capacity: int = CAPACITY) -> Counter[Pattern]:
    """Patterns and how often each is used, for a histogram {size: items}."""
    count = [0] * (capacity + 1)
    for s, n in sizes.items():
        if not 1 <= s <= capacity:
            raise ValueError(f"size {s} is outside 1..{capacity}")
        count[s] += n
    fixed = reduce_instance(count, capacity)
    return fixed + best_fit(count, capacity)


class Places:
    """For (size, rank among that size): sequence and offset, by binary search in runs of equal patterns."""

    def __init__(self, patterns: Counter[Pattern]):
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        base = 0
        for pattern, bins in sorted(patterns.items(), reverse=True):
            offset = 0
            for size, copies in pattern:
                for _ in range(copies):
                    runs[size].append((bins, base, offset))
                    offset += size
            base += bins
        self.bins = base
        self.runs = {s: (np.concatenate([[0], np.cumsum([r[0] for r in x])[:-1]]).astype(np.int64), np.array([r[1] for r in x], np.int64), np.array([r[2] for r in x], np.int64)) for s, x in runs.items()}

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order])) + 1
        for own in np.split(order, cuts):
            if len(own):
                starts, base, offset = self.runs[int(size[own[0]])]
                k = np.searchsorted(starts, rank[own], side="right") - 1
                seq[own], off[own] = base[k] + rank[own] - starts[k], offset[k]
        return seq, off


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("nth", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"
PLACED_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
PLACED = pa.schema([*list(PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece, numbered among the pieces of its length within its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, bpe, seen = TaskContext.get().partitionId(), byte_bpe(tokenizer), Counter()
        end = np.array([end_id], np.uint32)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                if text and len(text) < 20_000:
                    bpe.confirm(text)
                ids = bpe.encode(text)
                ids = np.concatenate([ids, end]).astype("<u4")
                for i, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    rows.append((doc, i, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, seen[length]))
                    seen[length] += 1
            if rows:
                yield batch(PIECES, list(zip(*rows)))

    return bound_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), PIECES_DDL)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Place every piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The pieces (not the texts) are materialised once, so tokenising happens once.
    The driver holds one counter for each size; the plan it ships has at most a
    few patterns for each size.
    """
    placed = cut(pieces(docs, tokenizer, end_id, capacity))
    counts = placed.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    found = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(solve(found, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = placed.join(offsets, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                seq, off = places.find(b.column(3).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False))
                yield batch(PLACED, [*b.columns[:5], seq, off])

    return ranked.mapInArrow(tidy(run), PLACED_DDL)
