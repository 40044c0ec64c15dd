"""Near-duplicate vectors from a robust-pruned flat graph (operator 4).

1. Equal vectors form one class at once; its smallest id stands for it.
2. Build.  Centroids are fitted on a bounded sample, for each length of vectors
   apart; their number grows with the rows.  Every vector lives in the HOMES
   nearest clusters; clusters longer than `BLOCK` are dealt into blocks.  In each such shard a node's candidates, its nearest ones and a few
   random far ones, are pruned robustly: a candidate goes when a kept one is
   closer to it, by a factor `ALPHA`, than the node is.
3. Union.  A node's adjacency lists from its shards are united: a link found in
   one shard serves every shard that holds both ends, and links run both ways.
4. Search.  Each vector is a query in its nearest clusters, as many (`visits`)
   as the sample's probes (see 6) need to meet the vectors that they were moved
   from: a greedy beam search from the shard's medoids, then range expansion,
   which follows links from every vector found in range until no new one is in
   range.
5. Verify.  Pairs in range are checked by cosine in double precision on the
   original vectors.  A task emits numbers of links and, for components, a
   spanning star of what it found, never the pairs of a group.
6. Audit.  Real vectors drawn at random and probes, which are vectors moved to
   a cosine between the radius and 1, have their links counted by brute force
   over all rows; each probe has one at least, however rare links are.  Probes
   are searched like any vector, but nothing finds them.  Recall is the mean
   over vectors of the share of links found, so a large group weighs no more
   than a pair; while it is under TARGET the beam and the visits widen and the
   search is repeated, until every vector is searched for in every shard.  The recall
   reached is returned as `audit_recall`.

Defined results: null, zero and non-finite vectors and rows with a null id link
with nothing and are their own component (null id: null component, not kept);
vectors of different lengths never link; rows that repeat an id count
separately; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import batch, cut, stored, tidy
from tessaline.llm.components import connected_components, local_roots
from tessaline.llm.vectors import Clusters, by_length, class_hash, cluster_count, cosines, packed, runs, sample, unit, unpacked, usable

SHARD, BLOCK = 1000, 8192
POOL, NEAR, FAR, ALPHA = 32, 16, 4, 1.2
BEAM, HOMES = 24, 2
AUDIT, PROBES, ENOUGH, TARGET = 2048, 256, 30, 0.98  # ENOUGH audited vectors with links are a measure of their own
SLACK = 1e-4  # navigation is in single precision
PAIRS = 1 << 16  # of vectors compared at once
ASKED = 1024  # queries whose finds are held at once


def prune(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """Robustly pruned neighbours of every row of x (unit rows)."""
    m = len(x)
    pool = min(POOL, m - 1)
    if pool < 1:
        return [np.zeros(0, np.int64)] * m
    far = np.random.default_rng(seed).integers(0, m, (m, FAR))
    out: list[np.ndarray] = []
    for i in range(0, m, 256):
        s = x[i : i + 256] @ x.T
        rows = np.arange(len(s))
        s[rows, i + rows] = -9
        near = np.argpartition(-s, pool - 1, axis=1)[:, :pool]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1), 1)
        to_node = 2 - 2 * np.take_along_axis(s, near, 1)
        among = 2 - 2 * np.matmul(x[near], x[near].transpose(0, 2, 1))
        alive, kept = np.ones(near.shape, bool), np.zeros(near.shape, bool)
        for _ in range(min(NEAR, pool)):
            k = alive.argmax(axis=1)
            go = alive[rows, k]
            kept[rows[go], k[go]] = True
            alive[rows, k] = False
            alive &= ALPHA * among[rows, k] > to_node
        out += [np.unique(np.concatenate([near[r, kept[r]], far[i + r][far[i + r] != i + r]])) for r in range(len(s))]
    return out


def ranged(x: np.ndarray, links: list[np.ndarray], q: np.ndarray, radius: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs in range, by greedy search from medoids and range expansion; x and q are unit rows."""
    m = len(x)
    degree = np.fromiter(map(len, links), np.int64, m)
    start, every = np.concatenate([[0], np.cumsum(degree)[:-1]]), np.concatenate([*links, np.zeros(0, np.int64)]).astype(np.int64)

    def neighbours(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in nodes, place in its list, node) of all neighbours."""
        n = degree[nodes]
        of = np.repeat(np.arange(len(nodes)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        return of, nth, every[start[nodes][of] + nth]

    def scores(own: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.concatenate([(own[rows[j : j + PAIRS]] * x[nodes[j : j + PAIRS]]).sum(axis=1) for j in range(0, len(rows), PAIRS)] or [np.zeros(0, own.dtype)])

    entries = np.unique(np.concatenate([[int((x @ x.mean(axis=0)).argmax())], np.linspace(0, m - 1, min(4, m)).astype(int)]))
    of, at = [], []
    for i in range(0, len(q), 128):
        own = q[i : i + 128]
        n = len(own)
        seen = np.zeros((n, m), bool)
        seen[:, entries] = True
        nodes = np.tile(entries, (n, 1))
        score = own @ x[entries].T
        opened = np.zeros(nodes.shape, bool)
        hit = [(a, nodes[a, b]) for a, b in [np.nonzero(score >= radius)]]
        while True:
            waiting = np.where(opened, -9, score)
            k = waiting.argmax(axis=1)
            rows = np.flatnonzero(waiting[np.arange(n), k] > -9)
            if not len(rows):
                break
            opened[rows, k[rows]] = True
            of_row, nth, new = neighbours(nodes[rows, k[rows]])
            fresh = ~seen[rows[of_row], new]
            of_row, nth, new = rows[of_row[fresh]], nth[fresh], new[fresh]
            seen[of_row, new] = True
            near = scores(own, of_row, new)
            width = int(nth.max()) + 1 if len(nth) else 0
            more, named = np.full((n, width), -9, own.dtype), np.zeros((n, width), np.int64)
            more[of_row, nth], named[of_row, nth] = near, new
            hit.append((of_row[near >= radius], new[near >= radius]))
            nodes, score, opened = np.hstack([nodes, named]), np.hstack([score, more]), np.hstack([opened, more <= -9])
            if nodes.shape[1] > beam:
                best = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
                nodes, score, opened = (np.take_along_axis(y, best, 1) for y in (nodes, score, opened))
        a, b = np.concatenate([h[0] for h in hit]), np.concatenate([h[1] for h in hit])
        while len(a):  # every vector in range hands on its links, a bounded number of them at a time
            of.append(a + i)
            at.append(b)
            found = []
            cuts = np.searchsorted(np.cumsum(degree[b]), np.arange(PAIRS, int(degree[b].sum()) + PAIRS, PAIRS), side="right").tolist()
            for j, z in zip([0, *cuts], [*cuts, len(a)]):
                which, _, new = neighbours(b[j:z])
                rows = a[j:z][which]
                fresh = ~seen[rows, new]
                code = np.unique(rows[fresh] * m + new[fresh])
                rows, new = code // m, code % m
                seen[rows, new] = True
                near = scores(own, rows, new) >= radius
                found.append((rows[near], new[near]))
            a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    return np.concatenate(of) if of else np.zeros(0, np.int64), np.concatenate(at) if at else np.zeros(0, np.int64)


def united(names: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Adjacency by position of links between names: all lists of a node together, both ways."""
    order = np.argsort(names)
    place = lambda z: order[np.searchsorted(names[order], z)]
    a, b = place(a), place(b)
    code = np.unique(np.concatenate([a * len(names) + b, b * len(names) + a]))
    return np.split(code % len(names), np.searchsorted(code // len(names), np.arange(1, len(names))))


ROWS_DDL = "shard int, block int, kind int, id long, mult long, homes binary, visits binary, body binary"
SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("mult", pa.int64()), ("homes", pa.binary()), ("visits", pa.binary()), ("body", pa.binary())])
FOUND = pa.schema([("probe", pa.bool_()), ("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])
PLACED = ["id", "mult", "body", "homes", "visits", "shard", "block", "parts"]
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
HOME, LINKS, GUEST = 0, 1, 2  # kinds of rows of a shard: residents with vectors, links that another task found, visitors


def sharded(classes: DataFrame, clusters: Clusters, visits: int) -> DataFrame:
    """Each class at each cluster it visits: id, mult, body (the vector), shard, block (where it lives there, else -1), parts (blocks of the shard), homes (shards and blocks it lives in), visits (shards)."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in by_length(b.column(2)):
                near = clusters.number(d, clusters.assign(d, unit(x), min(max(HOMES, visits), clusters.of(d))))
                rest = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*rest.columns[:2], packed(x), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["id", "mult", "body", "shards"])

    near = cut(classes.select("id", "mult", "v").mapInArrow(tidy(assign), "id long, mult long, body binary, shards array<int>"))
    held = near.where("mult > 0").select(F.explode(F.slice("shards", 1, HOMES)).alias("shard")).groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    sizes = dict(map(tuple, held.collect()))  # a row for each shard: the sample bounds them
    names = np.array(sorted(sizes), np.int64)
    parts_of = np.array([*(sizes[s] for s in names.tolist()), 0], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, at, shards in by_length(b.column(3)):
                rest, shard = b.take(pa.array(at)), shards.astype(np.int64)
                k = np.searchsorted(names, shard)
                parts = np.where(np.isin(shard, names), parts_of[np.minimum(k, len(names))], 0)  # nobody lives in some
                mixed = (rest.column(0).to_numpy().astype(np.uint64)[:, None] * MIX[0] ^ shard.astype(np.uint64)) * MIX[1]
                block = ((mixed >> np.uint64(33)) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64)
                homes = packed(((shard[:, :HOMES] + (1 << 31)) << 32 | block[:, :HOMES]).astype(">u8"))
                visited = packed((shard + (1 << 31)).astype(np.int64))
                for j in range(shard.shape[1]):
                    yield pa.RecordBatch.from_arrays([*rest.columns[:3], homes, visited, *[pa.array(x, pa.int32()) for x in (shard[:, j], block[:, j] if j < HOMES else np.full(len(at), -1), parts[:, j])]], PLACED)

    return near.mapInArrow(tidy(place), "id long, mult long, body binary, homes binary, visits binary, shard int, block int, parts int")


def home_codes(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Of each row its homes as numbers that sort by shard, then block."""
    return [np.frombuffer(h, ">u8") for h in column.to_pylist()]


def first_common(visits: np.ndarray, homes: list[np.ndarray], of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The smallest shard that visits[of[i]] and homes[at[i]] have in common, the shard where the pair counts."""
    width = max(map(len, homes))
    lived = np.stack([np.pad((h >> np.uint64(32)).astype(np.int64), (0, width - len(h)), constant_values=-1) for h in homes])
    out = np.full(len(of), np.iinfo(np.int64).max)
    for i in range(0, len(of), 65536):
        p, q = visits[of[i : i + 65536]], lived[at[i : i + 65536]]
        same = (p[:, :, None] == q[:, None, :]).any(axis=2)
        out[i : i + 65536] = np.where(same, p, np.iinfo(np.int64).max).min(axis=1)
    return out


def linked(classes: DataFrame, clusters: Clusters, radius: float, beam: int, visits: int) -> DataFrame:
    """(probe, id, n, root): links of a class or probe found in a shard, and a smaller class that a class is connected with there.

    Probes are the rows with mult 0.
    """
    placed = stored(sharded(classes, clusters, visits))
    resident = placed.where("mult > 0 AND block >= 0").select("shard", "block", F.lit(HOME).alias("kind"), "id", "mult", "homes", "visits", "body")
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: (F.col("mult") == 0) | (j != F.col("block"))))
    guests = placed.where("parts > 0").withColumn("other", other).select("shard", F.col("other").alias("block"), F.lit(GUEST).alias("kind"), "id", "mult", "homes", "visits", "body")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, _, _), rows in runs(batches, 3, 1 << 62):
            ids, homes = rows.column("id").to_numpy(), home_codes(rows.column("homes"))
            near = prune(unit(unpacked(rows.column("body"), np.float64)).astype(np.float32), abs(shard))
            a, b = np.repeat(np.arange(len(near)), [len(x) for x in near]), np.concatenate(near).astype(np.int64)
            if not len(a):
                continue
            # a link serves every home that both ends have
            width = max(map(len, homes))
            table = np.stack([np.pad(h.astype(np.uint64), (0, width - len(h)), constant_values=(1 << 64) - 1) for h in homes])
            for k in range(width):
                own = table[a, k]
                both = (own != (1 << 64) - 1) & (table[b] == own[:, None]).any(axis=1)
                if both.any():
                    code, n = own[both], int(both.sum())
                    order = np.argsort(code, kind="stable")
                    code, links = code[order], np.stack([ids[a[both]], ids[b[both]]], 1)[order]
                    cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), n]
                    heads = code[cuts[:-1]]
                    m = len(heads)
                    yield pa.RecordBatch.from_arrays([pa.array((heads >> np.uint64(32)).astype(np.int64) - (1 << 31), pa.int32()), pa.array((heads & np.uint64(0xFFFFFFFF)).astype(np.int64), pa.int32()), pa.array([LINKS] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array([np.ascontiguousarray(links[x:y]).tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary())], schema=SCHEMA)

    in_order = lambda df: df.repartition("shard", "block").sortWithinPartitions("shard", "block", "kind")
    links = in_order(resident).mapInArrow(tidy(build), ROWS_DDL)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_home: tuple[int, int] | None = None
        home: dict = {}
        pairs: list[pa.Table] = []

        def search(key: tuple[int, int], asked: pa.Table, graph: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for i in range(0, asked.num_rows, ASKED):
                yield from search_part(key, asked.slice(i, ASKED), graph)

        def search_part(key: tuple[int, int], asked: pa.Table, graph: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            w, names, probe, theirs = unpacked(asked.column("body"), np.float64), asked.column("id").to_numpy(), asked.column("mult").to_numpy() == 0, unpacked(asked.column("visits"), np.int64)
            of, at = ranged(home["x"], graph, unit(w).astype(np.float32), radius - SLACK, beam)
            ok = probe[of] | (names[of] != home["ids"][at])
            of, at = of[ok], at[ok]
            sure = np.concatenate([cosines(w[of[i : i + 65536]], home["v"][at[i : i + 65536]]) >= radius for i in range(0, len(of), 65536)] or [np.zeros(0, bool)])
            of, at = of[sure], at[sure]
            if not len(of):
                return
            first = first_common(theirs, home["homes"], of, at) == key[0] + (1 << 31)  # a pair counts in one shard
            n = np.bincount(of[first], home["mult"][at[first]], minlength=len(names)).astype(np.int64)
            real = ~probe[of]
            nodes, roots = local_roots(names[of[real]], home["ids"][at[real]])
            some = np.flatnonzero(n)
            yield batch(FOUND, [probe[some], names[some], n[some], pa.nulls(len(some), pa.int64())])
            yield batch(FOUND, [np.zeros(len(nodes), bool), nodes, np.zeros(len(nodes), np.int64), roots])

        def graph_of() -> list[np.ndarray]:
            if "graph" not in home:
                ends = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for t in pairs for x in t.column("body").to_pylist()] or [np.zeros((0, 2), np.int64)])
                home["graph"] = united(home["ids"], ends[:, 0], ends[:, 1])
            return home["graph"]

        def at_end() -> Iterator[pa.RecordBatch]:
            """Residents are searched once their links are read."""
            if home and "done" not in home:
                home["done"] = True
                yield from search(at_home, home["rows"], graph_of())

        for (shard, block, kind), rows in runs(batches, 3, BLOCK):
            if (shard, block) != at_home:
                yield from at_end()
                home, pairs, at_home = {}, [], (shard, block)
            if kind == HOME:
                rows = pa.concat_tables([home["rows"], rows]) if home else rows
                v = unpacked(rows.column("body"), np.float64)
                home = {"rows": rows, "v": v, "x": unit(v).astype(np.float32), "ids": rows.column("id").to_numpy(), "mult": rows.column("mult").to_numpy(), "homes": home_codes(rows.column("homes"))}
            elif kind == LINKS:
                pairs.append(rows)
            elif home:
                yield from at_end()
                yield from search(at_home, rows, graph_of())
        yield from at_end()

    return in_order(resident.union(links).union(guests)).mapInArrow(tidy(find), "probe boolean, id long, n long, root long")


def probes(samples: dict[int, np.ndarray], radius: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length (vectors, probes): PROBES sampled unit vectors in all at most, each turned in a random direction to a cosine between `radius` and 1."""
    rng, out, drawn = np.random.default_rng(23), {}, sum(map(len, samples.values()))
    for d, x in samples.items():
        own = x[rng.choice(len(x), min(len(x), max(1, PROBES * len(x) // drawn)), replace=False)]
        side = rng.normal(size=own.shape)
        side -= (side * own).sum(axis=1, keepdims=True) * own
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
        cosine = np.clip(radius + (1 - radius) * rng.uniform(0.02, 1, (len(own), 1)), -1, 1)
        out[d] = own, unit(cosine * own + np.sqrt(1 - cosine**2) * side) if d > 1 else own
    return out


def least_visits(planted: dict[int, tuple[np.ndarray, np.ndarray]], clusters: Clusters, target: float) -> int:
    """The fewest clusters to visit with which the share `target` of probes comes to a home of the vector it was moved from."""
    for visits in range(1, clusters.most()):
        met = [(a[:, :, None] == b[:, None, :]).any(axis=(1, 2)) for d, (x, y) in planted.items() for a, b in [(clusters.assign(d, x, min(HOMES, clusters.of(d))), clusters.assign(d, y, min(visits, clusters.of(d))))]]
        if np.concatenate(met).mean() >= target:
            return visits
    return clusters.most()


def audit(classes: DataFrame, n: int, radius: float, planted: dict[int, np.ndarray]) -> dict[tuple[bool, int], int]:
    """True numbers of links, by brute force over all: of probes, by (True, its number), and of about AUDIT classes to other classes, by (False, id)."""
    drawn = F.pmod(F.xxhash64(F.lit("audit"), "id"), F.lit(1 << 30)) < int(min(1.0, AUDIT / max(1, n)) * (1 << 30))
    got = classes.where(drawn).select("id", "v").toArrow().combine_chunks()
    real = {d: (got.column("id").to_numpy()[at], unit(x)) for d, at, x in by_length(got.column("v").combine_chunks())} if got.num_rows else {}
    asked: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    first = 0
    for d in sorted({*planted, *real}):
        ids, x = real.get(d, (np.zeros(0, np.int64), np.zeros((0, d))))
        own = planted.get(d, np.zeros((0, d)))
        asked[d] = np.arange(len(ids) + len(own)) >= len(ids), np.concatenate([ids, np.arange(first, first + len(own))]).astype(np.int64), np.concatenate([x, own])
        first += len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: np.zeros(len(ids), np.int64) for d, (_, ids, _) in asked.items()}
        for b in batches:
            for d, at, v in by_length(b.column(2)):
                if d in asked:
                    probe, ids, x = asked[d]
                    own, mult = b.column(0).to_numpy()[at], b.column(1).to_numpy()[at]
                    for i in range(0, len(v), 1024):
                        near = (x @ unit(v[i : i + 1024]).T >= radius) & (probe[:, None] | (ids[:, None] != own[None, i : i + 1024]))
                        total[d] += near @ mult[i : i + 1024]
        for d, (probe, ids, _) in asked.items():
            yield pa.RecordBatch.from_arrays([pa.array(probe), pa.array(ids), pa.array(total[d])], ["probe", "id", "n"])

    counted = classes.select("id", "mult", "v").mapInArrow(tidy(run), "probe boolean, id long, n long").groupBy("probe", "id").agg(F.sum("n").alias("n"))
    return {(r["probe"], r["id"]): r["n"] for r in counted.where("n > 0").collect()}


def audited(truth: dict[tuple[bool, int], int], got: dict[tuple[bool, int], int]) -> float:
    """Mean share of its links that a vector found: the lower one of probes and real vectors, or of all where real ones are few."""
    share = {k: min(got.get(k, 0), n) / n for k, n in truth.items()}
    real, planted = ([v for (p, _), v in share.items() if p == kind] for kind in (False, True))
    parts = [real, planted] if len(real) >= ENOUGH else [real + planted]
    return min((sum(p) / len(p) for p in parts if p), default=1.0)


def near_vectors(rows: DataFrame, key: str, vector: str, radius: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept, audit_recall for every row."""
    own = usable(rows, key, vector).select("id", "v", *class_hash(F.col("v")))
    classes = cut(own.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("mult"), F.first("v").alias("v")))
    n = classes.count()
    samples = sample(classes, n, cluster_count(n, SHARD))
    recall = 1.0
    if n:
        clusters, planted = Clusters(samples, n, SHARD), probes(samples, radius)
        beam, visits = BEAM, least_visits(planted, clusters, (1 + TARGET) / 2)
        moved = [v for d in sorted(planted) for v in planted[d][1].tolist()]
        truth = audit(classes, n, radius, {d: y for d, (_, y) in planted.items()})
        asked = classes.select("id", "mult", "v").union(rows.sparkSession.createDataFrame([(i, 0, v) for i, v in enumerate(moved)], "id long, mult long, v array<double>"))
    while n:
        every_found = cut(linked(asked, clusters, radius, beam, visits).groupBy("probe", "id", "root").agg(F.sum("n").alias("n")))
        found = every_found.where("NOT probe")
        counted = found.groupBy("id").agg(F.sum("n").alias("n"))
        real = [i for p, i in truth if not p]
        got = {(r["probe"], r["id"]): r["n"] for r in every_found.where(F.col("probe") | F.col("id").isin(real)).groupBy("probe", "id").agg(F.sum("n").alias("n")).collect()}
        recall = audited(truth, got)
        if recall >= TARGET or (visits >= clusters.most() and beam >= BLOCK):
            break
        beam, visits = min(beam * 2, BLOCK), visits + 1
    every = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    if not n:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"), F.lit(1.0).alias("audit_recall"))
    components = connected_components(found.where("root IS NOT NULL"), "id", "root")
    facts = classes.select("h1", "h2", "mult", F.col("id").alias("rep")).join(counted.withColumnRenamed("id", "rep"), "rep", "left").join(components, F.col("rep") == F.col("node"), "left")
    facts = facts.select("h1", "h2", "rep", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    taking = F.col("vec_id").isNotNull()
    joined = every.select("vec_id", *[F.when(taking, h).alias(k) for h, k in zip(class_hash(F.col("v")), ("h1", "h2"))]).join(facts, ["h1", "h2"], "left")
    component = F.when(taking, F.coalesce("component", "vec_id"))
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(recall).alias("audit_recall"))
