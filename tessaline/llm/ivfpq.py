"""Approximate nearest neighbours from an inverted file with product-quantised residuals (operator 6).

Index.  Coarse centroids (their number grows with the square root of the rows)
and the codebooks of the residuals are fitted on a bounded sample
(`vectors.sample`); every row is then indexed: its list, its residual's codes,
and the norm of what the codes miss.  Equal vectors share one entry with their
smallest ids, so a hot vector is one entry.

Search.  A query visits its nearest lists.  Only codes lie in a list, vectors
stay behind.  A table of inner products of the query with each codeword turns
codes into approximate scores; entries whose score could still reach the best
ones, given what their codes miss (`sigmas` standard deviations), are
candidates.  Within a list they are held against the list's best and against a
floor from the sample, afterwards against the best of all lists visited; then
their vectors are fetched for reranking by exact cosine in double precision.
There is no cap on how many are reranked, so a dense group that codes can't
tell apart is settled exactly.  Lists longer than `BLOCK` are dealt into blocks
that queries visit one by one.

Recall is audited end to end: for a bounded set of queries the true neighbours
are found by brute force over all rows; a true neighbour counts as found when
its list is visited and its approximate score passes the pruning.  `sigmas` is
the least number with which pruning keeps all but half of what TARGET allows to
lose, lists visited the least number with which recall reaches TARGET, up to
all lists and all entries, which is exact.  The recall is returned as
`audit_recall`.

Defined results: null, zero and non-finite vectors and those with a null id
take no part; a vector is compared with those of its own length; an id that
several rows hold is one query, with the best of its rows' vectors, and one
candidate; equal scores go to the smaller id; with fewer than `top` candidates
all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline.llm.common import spread_join, stored, tidy
from tessaline.llm.vectors import Clusters, by_length, class_hash, cluster_count, cosines, kmeans, nearest, packed, runs, sample, unit, unpacked, usable

PARTS, WORDS = 16, 256
GRID = (0.5, 1, 1.5, 2, 2.5, 3, 4, 6, 1e9)  # sigmas tried; the last prunes nothing
BLOCK = 8192
GUESTS = 4096  # queries held at once beside a block
AUDIT, TARGET = 96, 0.97


class Index:
    """Clusters and residual codebooks of each length; unit vectors in, codes out."""

    def __init__(self, samples: dict[int, np.ndarray], n: int):
        self.samples = {d: x.astype(np.float32) for d, x in samples.items()}
        self.clusters = Clusters(samples, n, max(1.0, math.sqrt(n)))
        self.books: dict[int, list[np.ndarray]] = {}
        for d, x in samples.items():
            residual = x - self.clusters.centroids[d][self.clusters.assign(d, x, 1)[:, 0]]
            self.books[d] = [kmeans(part, WORDS, 6, spherical=False) for part in np.array_split(residual, min(PARTS, d), axis=1)]

    def centre(self, d: int, own: np.ndarray) -> np.ndarray:
        return self.clusters.centroids[d][own] if d in self.books else np.zeros((len(own), d))

    def encode(self, d: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List within its length, codes and standard deviation of the score's error for each unit vector."""
        own = self.clusters.assign(d, x, 1)[:, 0]
        residual = x - self.centre(d, own)
        if d not in self.books:  # no codes: the error is whatever the vector is
            return own, np.zeros((len(x), 0), np.uint8), np.full(len(x), np.inf)
        parts = np.array_split(residual, len(self.books[d]), axis=1)
        codes = np.stack([nearest(p, b, 1, spherical=False)[:, 0] for p, b in zip(parts, self.books[d])], 1)
        missed = residual - np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books[d])], axis=1)
        return own, codes.astype(np.uint8), np.linalg.norm(missed, axis=1) / math.sqrt(d)

    def tables(self, d: int, q: np.ndarray) -> np.ndarray:
        """[part, word, query] inner products."""
        books = self.books.get(d, [])
        out = np.zeros((len(books), WORDS, len(q)), np.float32)
        for i, (p, b) in enumerate(zip(np.array_split(q, len(books), axis=1) if books else [], books)):
            out[i, : len(b)] = b @ p.T
        return out

    def approximate(self, d: int, q: np.ndarray, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """[entry, query] scores from codes."""
        out = (self.centre(d, np.arange(self.clusters.of(d))) @ q.T).astype(np.float32)[own]
        for table, code in zip(self.tables(d, q), codes.T):
            out += table[code]
        return out

    def floors(self, d: int, q: np.ndarray, rank: int) -> np.ndarray:
        """A score that at least `rank` rows reach, from the sample; -inf where it is too small to tell."""
        if d not in self.samples or len(self.samples[d]) < rank:
            return np.full(len(q), -np.inf)
        parts = (q[i : i + 256].astype(np.float32) @ self.samples[d].T for i in range(0, len(q), 256))
        return np.concatenate([np.partition(s, -rank, axis=1)[:, -rank] for s in parts] or [np.zeros(0)]) - 1e-5


ENTRIES_DDL = "h1 long, h2 long, asked boolean, ids array<long>, v array<double>, d int, list int, codes binary, spread double"


def entries(rows: DataFrame, asked: Column, index: Index, copies: int) -> DataFrame:
    """One entry for each distinct vector: its number, whether a query has it, its `copies` smallest ids, list and codes."""
    own = rows.select("id", "v", *class_hash(F.col("v")), asked.alias("asks"))
    first = Window.partitionBy("h1", "h2").orderBy("id")
    few = own.select("h1", "h2", "id").distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= copies)
    few = few.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    facts = own.groupBy("h1", "h2").agg(F.max("asks").alias("asked"), F.first("v").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in by_length(b.column(4)):
                own, codes, spread = index.encode(d, unit(x))
                rest = b.take(pa.array(at))
                lists = index.clusters.number(d, own)
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(np.full(len(at), d), pa.int32()), pa.array(lists, pa.int32()), packed(codes), pa.array(spread)], [*rest.schema.names, "d", "list", "codes", "spread"])

    return facts.join(few, ["h1", "h2"]).select("h1", "h2", "asked", "ids", "v").mapInArrow(tidy(run), ENTRIES_DDL).withColumn("eid", F.monotonically_increasing_id())


def audit(found: DataFrame, index: Index, n_asked: int, top: int, target: float) -> tuple[float, float, float]:
    """(sigmas, share of a length's lists to visit, recall): by brute force for about AUDIT queries over all entries."""
    drawn = F.pmod(F.xxhash64(F.lit("audit"), "h1"), F.lit(1 << 30)) < int(min(1.0, AUDIT / max(1, n_asked)) * (1 << 30))
    got = found.where(F.col("asked") & drawn).select("eid", "v").toArrow().combine_chunks()
    if not got.num_rows:
        return GRID[-1], 1.0, 1.0
    queries = {d: (got.column("eid").to_numpy()[at], unit(x)) for d, at, x in by_length(got.column("v").combine_chunks())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in by_length(b.column(1)):
                if d not in queries:
                    continue
                ids, q = queries[d]
                eid, lists = b.column(0).to_numpy()[at], b.column(3).to_numpy()[at]
                codes = unpacked(b.column(4).take(pa.array(at)), np.uint8) if d in index.books else np.zeros((len(at), 0), np.uint8)
                spread = b.column(5).to_numpy()[at]
                near = index.approximate(d, q, lists - index.clusters.number(d, np.zeros(1, np.int64))[0] if d in index.books else np.zeros(len(at), np.int64), codes).T
                exact = q @ unit(x).T
                exact[ids[:, None] == eid[None, :]] = -9
                best = np.argsort(-exact, axis=1)[:, :top]
                rough = -np.sort(-near, axis=1)[:, : top + 1]
                row = np.repeat(np.arange(len(ids)), best.shape[1])
                k = best.ravel()
                ok = exact[row, k] > -9
                row, k = row[ok], k[ok]
                other = np.repeat(np.arange(len(ids)), rough.shape[1])
                names = ["query", "list", "exact", "rough", "spread"]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(lists[k], pa.int32()), pa.array(exact[row, k]), pa.array(near[row, k].astype(float)), pa.array(spread[k])], names)
                yield pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.nulls(len(other), pa.int32()), pa.nulls(len(other), pa.float64()), pa.array(rough.ravel().astype(float)), pa.nulls(len(other), pa.float64())], names)

    seen = found.select("eid", "v", "d", "list", "codes", "spread").mapInArrow(tidy(run), "query long, list int, exact double, rough double, spread double")
    kind = F.col("exact").isNull()
    rank = F.row_number().over(Window.partitionBy("query", kind).orderBy(F.desc(F.coalesce("exact", "rough"))))
    few = seen.withColumn("nth", rank).where(F.col("nth") <= F.when(kind, top + 1).otherwise(top)).toArrow().to_pylist()  # AUDIT * (2 * top + 1) rows
    worst: dict[int, float] = {}
    floors = {int(i): float(f) for d, (ids, q) in queries.items() for i, f in zip(ids, index.floors(d, q, top + 1))}
    for r in few:
        if r["exact"] is None:
            worst[r["query"]] = min(worst.get(r["query"], np.inf), r["rough"])
    true = [r for r in few if r["exact"] is not None]
    if not true:
        return GRID[-1], 1.0, 1.0
    deficit = np.array([(max(worst[r["query"]], floors[r["query"]]) - r["rough"]) / r["spread"] if np.isfinite(r["spread"]) and r["spread"] > 0 else -np.inf for r in true])
    sigmas = next(z for z in GRID if (deficit <= z).mean() >= 1 - (1 - target) / 2)
    share: dict[int, np.ndarray] = {}
    for d, (ids, q) in queries.items():
        order = np.argsort(index.clusters.assign(d, q, index.clusters.of(d)), axis=1)
        base = int(index.clusters.number(d, np.zeros(1, np.int64))[0])
        share |= {int(i): np.append((order[k] + 1) / order.shape[1], base) for k, i in enumerate(ids)}
    lists = np.array([share[r["query"]][r["list"] - int(share[r["query"]][-1])] if r["list"] >= 0 else 0.0 for r in true])
    kept = deficit <= sigmas
    wanted = np.sort(lists[kept])
    need = min(len(wanted) - 1, max(0, math.ceil(target * len(true)) - 1))
    return sigmas, float(wanted[need]), float((kept & (lists <= wanted[need])).mean())


def candidates(found: DataFrame, index: Index, sigmas: float, share: float, top: int) -> DataFrame:
    """(qid, eid, rough, spread): entries of visited lists that could be among the best of a list and reach the sample's floor."""
    held = found.groupBy("list").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    sizes = dict(map(tuple, held.select("list", "n").collect()))  # a row for each list: MAX_CLUSTERS and the sample bound them

    def lists_of(d: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[query, visit] lists of a query, nearest first, and how many entries lie in those before each."""
        every = np.array([sizes.get(i, 0) for i in index.clusters.number(d, np.arange(index.clusters.of(d))).tolist()])
        m = max(1, math.ceil(share * index.clusters.of(d) - 1e-9))
        while True:
            near = index.clusters.assign(d, q, min(m, index.clusters.of(d)))
            total = np.cumsum(every[near], axis=1)
            if m >= index.clusters.of(d) or (total[:, -1] > top).all():
                return near, total - every[near]
            m *= 2

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in by_length(b.column(1)):
                q = unit(x)
                near, before = lists_of(d, q)
                k = np.repeat(np.arange(len(q)), near.shape[1])
                # the nearest lists give at least top + 1 entries, whatever the floor
                floor = np.where(before.ravel() <= top, -np.inf, index.floors(d, q, top + 1)[k]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(index.clusters.number(d, near.ravel()), pa.int32()), b.column(0).take(pa.array(at[k])), packed(q.astype(np.float32)).take(pa.array(k)), pa.array(floor, pa.float64())], ["list", "eid", "body", "spread"])

    blocks = F.broadcast(held.select("list", "blocks"))
    residents = found.join(blocks, "list").select("list", F.pmod(F.xxhash64("eid"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), "d", "eid", F.col("codes").alias("body"), "spread")
    guests = found.where("asked").select("eid", "v").mapInArrow(tidy(visits), "list int, eid long, body binary, spread double").join(blocks, "list")
    guests = guests.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), F.lit(0).alias("d"), "eid", "body", "spread")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home: tuple = ()
        parts: list[pa.Table] = []
        for (number, block, kind), rows in runs(batches, 3, GUESTS):
            if kind == 0:
                parts = [*parts, rows] if parts and home == (number, block) else [rows]
                home, ready = (number, block), None
                continue
            if home != (number, block):
                continue
            if ready is None:
                own = pa.concat_tables(parts)
                d = own.column("d")[0].as_py()
                coded = d in index.books
                ready = d, own.column("eid").to_numpy(), unpacked(own.column("body"), np.uint8) if coded else np.zeros((own.num_rows, 0), np.uint8), own.column("spread").to_numpy(), number - int(index.clusters.number(d, np.zeros(1, np.int64))[0]) if coded else 0
            d, eid, codes, spread, place = ready
            q, qid, floor = unpacked(rows.column("body"), np.float32), rows.column("eid").to_numpy(), rows.column("spread").to_numpy()
            slack = np.minimum(sigmas * spread, 9).astype(np.float32)
            for i in range(0, len(q), 128):
                rough = index.approximate(d, q[i : i + 128], np.full(len(eid), place), codes)
                low = np.maximum(floor[i : i + 128], np.partition(rough, -(top + 1), axis=0)[-(top + 1)] if len(eid) > top + 1 else -np.inf)
                a, k = np.nonzero(rough + slack[:, None] >= low.astype(np.float32))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(qid[i + k]), pa.array(eid[a]), pa.array(rough[a, k].astype(float)), pa.array(slack[a].astype(float))], ["qid", "eid", "rough", "slack"])

    columns = ["list", "block", "kind", "d", "eid", "body", "spread"]
    placed = residents.select(*columns).union(guests.select(*columns)).repartition("list", "block").sortWithinPartitions("list", "block", "kind")
    return placed.mapInArrow(tidy(run), "qid long, eid long, rough double, slack double")


def search(rows: DataFrame, asked: Column, top: int = 5, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score, audit_recall; rows are (id, v) as `vectors.usable` gives them, queries those where `asked` is true."""
    n = rows.count()
    samples = sample(rows, n, cluster_count(n, max(1.0, math.sqrt(n))))
    if not samples:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, audit_recall double")
    index = Index(samples, n)
    found = stored(entries(rows, asked, index, top + 1))
    sigmas, share, recall = audit(found, index, found.where("asked").count(), top, target)
    near = candidates(found, index, sigmas, share, top).withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rough"))))
    floor = F.min(F.when(F.col("nth") <= top + 1, F.col("rough"))).over(Window.partitionBy("qid"))
    near = near.withColumn("floor", floor).where("rough + slack >= floor").select("qid", "eid")
    body = found.select(F.col("eid").alias("name"), "v", "ids")
    met = near.join(body.select("name", F.col("v").alias("q")), F.col("qid") == F.col("name")).drop("name").join(body, F.col("eid") == F.col("name"))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, q in by_length(b.column(1)):
                x = np.asarray(b.column(2).take(pa.array(at)).flatten(), dtype=np.float64).reshape(len(at), d)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(3).take(pa.array(at)), pa.array(cosines(q, x))], ["qid", "ids", "score"])

    scored = met.select("qid", "q", "v", "ids").mapInArrow(tidy(rerank), "qid long, ids array<long>, score double")
    # one more answer than asked for, as a query's own row is among them; classes of equal queries share their answers
    each = scored.select("qid", "score", F.explode("ids").alias("vec_id")).withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("nth") <= top + 1)
    answers = each.groupBy("qid").agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))
    queries = rows.where(asked).select("id", *class_hash(F.col("v")))
    facts = queries.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).join(found.select("h1", "h2", F.col("eid").alias("qid")), ["h1", "h2"]).join(answers, "qid").select("h1", "h2", "n", "near")
    told = spread_join(queries, stored(facts), ["h1", "h2"], "n").select(F.col("id").alias("query_id"), F.explode("near").alias("a"))
    best = told.select("query_id", "a.vec_id", "a.score").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score", F.lit(recall).alias("audit_recall"))


def neighbours(rows: DataFrame, key: str, vector: str, every: int, top: int = 5) -> DataFrame:
    """The `top` nearest other rows of each row whose key is divisible by `every`."""
    return search(stored(usable(rows, key, vector)), F.col("id") % every == 0, top)
