"""MinHash near-dedup with sequential Bayesian verification (operator 7).

1. Each text becomes the set of its word shingles (64-bit hashes) and a MinHash
   signature.  Texts with equal sets form one class at once; its smallest
   doc_id stands for it, so exact copies cost nothing further.
2. Signatures are banded.  Every bucket links its members to its smallest
   member as candidates: n - 1 candidates for n members, never n squared.
3. Candidates are compared a few signature positions at a time.  After m of n
   positions agree, the similarity has a Beta(m+1, n-m+1) posterior; a pair
   whose chance of reaching the threshold is under `miss` is dropped.
4. Survivors are verified on full shingle sets, recomputed from the texts of
   the documents concerned, which are set aside in one pass.
5. Buckets that still hold more than one component are searched in full, across
   components only: members outside the bucket's main component are compared
   with all members, block by block, so a link that the star of step 2 did not
   show is not lost, and no bucket is ever held whole.  Signatures travel first
   and are pruned as in step 3 (`met`); texts follow only to the blocks where a
   pair kept its chance, and are verified there (`second_look`).

Joins on set hashes, bucket keys and nodes broadcast what belongs to hot keys
(`spread_join`), so a group that holds a third of all rows lands in no one task.

Components are computed on links alone.  Nothing grows with the square of a
group of copies, and no list of documents reaches the driver.

Defined results: null, empty and blank texts have the empty set and link with
nothing; a text with fewer words than a shingle is one shingle; a row with a
null doc_id links with nothing, has a null component and is not kept; rows that
repeat a doc_id are judged each by its text; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import batch, bound_batches, cut, spread_join, stored, tidy
from tessaline.llm.components import connected_components, local_roots

MISS = 1e-6
BAND_MISS = 2e-5
STEP = 16  # signature positions compared at a time
BLOCK = 512  # bucket members that one group of a second look holds
FAN = 256  # partners of one document that one group of a verification holds

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def bands_for(threshold: float) -> tuple[int, int]:
    """(bands, rows): the widest bands of at most 160 positions that miss a pair at the threshold with chance BAND_MISS at most."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(BAND_MISS) / math.log1p(-(threshold**rows)))
        if bands * rows <= 160:
            return bands, rows
    return 160, 1


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; fewer words than `width` make one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    span = min(width, len(h))
    n = len(h) - span + 1
    out = np.full(n, np.uint64(span))
    for i in range(span):
        out = (out ^ h[i : i + n]) * _MIX[i % 8]
        out ^= out >> np.uint64(29)
    out *= _MIX[1]
    out ^= out >> np.uint64(32)
    return np.unique(out)


@lru_cache(maxsize=4)
def permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    return (rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1))[:, None], rng.integers(0, 1 << 32, k, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """k minima of the set's 32-bit hashes under linear permutations."""
    a, b = permutations(k)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (x[None, i : i + 1024] * a + b).min(axis=1), out=out)
    return out


@lru_cache(maxsize=8)
def least_matches(threshold: float, miss: float, k: int) -> tuple[int, ...]:
    """For n = STEP, 2*STEP, ... positions: the fewest matches that leave the pair a chance over `miss`.

    With a uniform prior, P(similarity >= t | m of n) is the chance that a Binomial(n+1, t) is at most m.
    """
    out = []
    for n in range(STEP, k + 1, STEP):
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def survivors(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which of the pairs left[i], right[j] keep a chance, by batches of positions."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int32)
    k = left.shape[1] if left.ndim == 2 else 0
    for step, least in enumerate(least_matches(threshold, miss, k)):
        at = slice(step * STEP, (step + 1) * STEP)
        matches = matches + (left[i[alive], at] == right[j[alive], at]).sum(axis=1, dtype=np.int32)
        ok = matches >= least
        alive, matches = alive[ok], matches[ok]
        if not len(alive):
            break
    return alive


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.binary())])


def signed(docs: DataFrame, width: int, k: int) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (a 128-bit hash of the set), sig; the texts stay behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2, sigs = [], [], [], []
            for text in b.column(1):
                s = shingle_set(text.as_py(), width)
                n.append(len(s))
                d = xxhash.xxh3_128_digest(s.tobytes())
                h1.append(int.from_bytes(d[:8], "little", signed=True))
                h2.append(int.from_bytes(d[8:], "little", signed=True))
                sigs.append(signature(s, k).tobytes() if len(s) else None)
            yield batch(SIGNED, [b.column(0), n, h1, h2, sigs])

    return bound_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.uint32) for x in column.to_pylist()])


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def plausible(pairs: DataFrame, reps: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs (a, b) whose signatures leave them a chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                every = np.arange(x.num_rows)
                ok = survivors(_matrix(x.column(2)), _matrix(x.column(3)), every, every, threshold, miss)
                yield batch(PAIRS, [x.column(0).take(pa.array(ok)), x.column(1).take(pa.array(ok))])

    left = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"))
    right = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(tidy(run), "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, width: int, per_cent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= per_cent * union on full sets; texts: (id, text).

    Partners of a are dealt into groups of about FAN; a's text goes once to each group, ahead of its partners', and
    a task reads its groups as a stream.
    """
    fans = cut(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    partners = spread_join(pairs, fans, ["a"], "n")
    fans = fans.withColumn("fans", F.ceil(F.col("n") / FAN).cast("int")).drop("n")
    partners = partners.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / FAN)).cast("int").alias("fan"))
    heads = texts.join(fans, texts["id"] == fans["a"]).select("a", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan"), F.lit(0).alias("kind"), F.col("a").alias("b"), "text")
    rest = partners.join(texts, partners["b"] == texts["id"]).select("a", "fan", F.lit(1).alias("kind"), "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, np.zeros(0, np.uint64)
        for x in batches:
            found = []
            for a, kind, b, text in zip(x.column(0).to_pylist(), x.column(2).to_pylist(), x.column(3).to_pylist(), x.column(4)):
                if kind == 0:
                    head, own = a, shingle_set(text.as_py(), width)
                elif head == a and linked(own, shingle_set(text.as_py(), width), per_cent):
                    found.append((a, b))
            if found:
                yield batch(PAIRS, list(zip(*found)))

    return heads.union(rest).repartition("a", "fan").sortWithinPartitions("a", "fan", "kind").mapInArrow(tidy(run), "a long, b long")


def linked(a: np.ndarray, b: np.ndarray, per_cent: int) -> bool:
    if 100 * min(len(a), len(b)) < per_cent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= per_cent * (len(a) + len(b) - both)


MET = pa.schema([("key", pa.int64()), ("block", pa.int32()), ("kind", pa.int32()), ("band", pa.int32()), ("rep", pa.int64()), ("comp", pa.int64()), ("guest", pa.bool_())])
MET_DDL = "key long, block int, kind int, band int, rep long, comp long, guest boolean"


def visits(rows: Iterator[tuple]) -> Iterator[tuple[tuple, list[tuple], list[tuple]]]:
    """((key, block, band), residents, at most BLOCK guests) of rows (key, block, kind, band, ...) in that order; members keep what follows."""
    now, home, guests = None, [], []
    for key, block, kind, band, *rest in rows:
        if (key, block, band) != now or len(guests) >= BLOCK:
            if home and guests:
                yield now, home, guests
            home, guests, now = (home if (key, block, band) == now else []), [], (key, block, band)
        (guests if kind else home).append(tuple(rest))
    if home and guests:
        yield now, home, guests


def chances(band: int, rows: int, home: list[tuple], guests: list[tuple], signatures: tuple[np.ndarray, np.ndarray], threshold: float, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (guest, resident) of pairs of different components that keep a chance, each in the first band that it shares; members are (rep, comp, guest, ...)."""
    left, right = signatures
    ids, gids = np.array([h[0] for h in home]), np.array([g[0] for g in guests])
    comps, gcomps = np.array([h[1] for h in home]), np.array([g[1] for g in guests])
    also = np.array([h[2] for h in home])  # two guests meet in both their blocks
    i, j = np.nonzero((gcomps[:, None] != comps[None, :]) & ~(also[None, :] & (gids[:, None] > ids[None, :])))
    ok = survivors(left, right, i, j, threshold, miss)
    i, j = i[ok], j[ok]
    if band:
        earlier = (left[i, : band * rows] == right[j, : band * rows]).reshape(len(i), band, rows).all(axis=2).any(axis=1)
        i, j = i[~earlier], j[~earlier]
    return i, j


def met(mixed: DataFrame, threshold: float, rows: int, miss: float) -> DataFrame:
    """MET rows of the members whose signatures keep a chance with one that they meet: the visits that texts must repeat.

    mixed: key, band, n, guests, main, rep, comp, sig of all members of buckets with several components, n and guests
    being numbers of members in all and of those outside the main component.  A block holds about BLOCK residents and
    as many guests at most: guests are dealt into parties, and each party visits every row of residents.
    """
    dealt = mixed.withColumn("rows", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("parties", F.ceil(F.col("guests") / BLOCK).cast("int")).withColumn("guest", F.col("comp") != F.col("main"))
    row, party = F.pmod(F.xxhash64("rep"), "rows").cast("int"), F.pmod(F.xxhash64(F.lit(1), "rep"), "parties").cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    residents = dealt.withColumn("other", each("parties")).select("key", (row * F.col("parties") + F.col("other")).alias("block"), F.lit(0).alias("kind"), "band", "rep", "comp", "guest", "sig")
    visitors = dealt.where("guest").withColumn("other", each("rows")).select("key", (F.col("other") * F.col("parties") + party).alias("block"), F.lit(1).alias("kind"), "band", "rep", "comp", "guest", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = lambda members: np.stack([np.frombuffer(m[3], np.uint32) for m in members])
        for (key, block, band), home, guests in visits(r for x in batches for r in zip(*(c.to_pylist() for c in x.columns))):
            i, j = chances(band, rows, home, guests, (signs(guests), signs(home)), threshold, miss)
            seen = [(key, block, kind, band, *m[:3]) for kind, own, at in ((0, home, j), (1, guests, i)) for m in (own[k] for k in np.unique(at).tolist())]
            if seen:
                yield batch(MET, list(zip(*seen)))

    placed = residents.union(visitors).repartition("key", "block").sortWithinPartitions("key", "block", "kind")
    return placed.mapInArrow(tidy(run), MET_DDL).distinct()


def second_look(mixed: DataFrame, texts: DataFrame, width: int, per_cent: int, bands: int, rows: int, miss: float) -> DataFrame:
    """Verified links (a, b) between the components of a bucket; mixed as for `met`.

    Pairs that keep a chance are verified on full sets where they meet, and what leaves a task is a spanning star over
    components.
    """
    k, threshold = -(-bands * rows // STEP) * STEP, per_cent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[tuple]:
            for x in batches:
                for *own, text in zip(*(c.to_pylist() for c in x.columns[:7]), x.column(7)):
                    yield (*own, shingle_set(text.as_py(), width))

        for (_, _, band), home, guests in visits(members()):
            signs = lambda own: np.stack([signature(m[3], k) for m in own])
            joined: set[tuple[int, int]] = set()
            for x, y in zip(*(at.tolist() for at in chances(band, rows, home, guests, (signs(guests), signs(home)), threshold, miss))):
                link = (guests[x][1], home[y][1])
                if link not in joined and linked(guests[x][3], home[y][3], per_cent):
                    joined.add(link)
            if joined:
                a, b = local_roots(*np.array(sorted(joined), np.int64).T)
                yield batch(PAIRS, [a, b])

    # a member that many blocks want is read once and copied to each of them
    wanted = met(mixed, threshold, rows, miss).join(texts, F.col("rep") == F.col("id")).select("key", "block", "kind", "band", "rep", "comp", "guest", "text")
    return wanted.repartition("key", "block").sortWithinPartitions("key", "block", "kind").mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, per_cent: int = 80, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`."""
    threshold = per_cent / 100
    bands, rows = bands_for(threshold)
    k = -(-bands * rows // STEP) * STEP
    sigs = stored(signed(docs, width, k))
    usable = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(usable.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    # one row for each set, however often its smallest doc_id is repeated
    reps = spread_join(usable.select("doc_id", "h1", "h2", "sig"), classes, ["h1", "h2"], "copies").where("doc_id = rep").dropDuplicates(["h1", "h2"]).select("rep", "sig")
    reps = stored(reps)
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (4 * rows) + 1, F.lit(4 * rows))))
    banded = stored(reps.select("rep", F.posexplode(keys).alias("band", "key")))
    buckets = stored(banded.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("n")).where("head < last").select("key", "head", "n"))
    shared = stored(spread_join(banded, buckets, ["key"], "n").where("n IS NOT NULL"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = stored(texts.join(shared.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"))
    star = shared.where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    likely = cut(plausible(star, reps, threshold, miss).distinct())
    first = cut(connected_components(verified(likely, texts, width, per_cent), "a", "b"))
    placed = stored(shared.where("n > 2").join(first, shared["rep"] == first["node"], "left").select("key", "band", "n", "head", "rep", F.coalesce("component", "rep").alias("comp")))
    parts = placed.groupBy("key", "comp").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("own"), F.max(F.col("rep") == F.col("head")).alias("with_head"))
    several = parts.groupBy("key").agg(F.first("n").alias("members"), F.count(F.lit(1)).alias("comps"), F.min(F.when(F.col("with_head"), F.col("comp"))).alias("main"), (F.first("n") - F.max(F.when(F.col("with_head"), F.col("own")))).alias("guests"))
    mixed = spread_join(placed, stored(several.where("comps > 1").select("key", "main", "guests", "members")), ["key"], "members").where("main IS NOT NULL")
    mixed = mixed.join(reps, "rep").select("key", "band", "n", "guests", "main", "rep", "comp", "sig")
    second = connected_components(second_look(mixed, texts, width, per_cent, bands, rows, miss), "a", "b").select(F.col("node").alias("was"), F.col("component").alias("now"))
    known = first.join(second, first["component"] == second["was"], "left").select("node", F.coalesce("now", "component").alias("component"))
    extra = second.join(first, first["node"] == second["was"], "left_anti").select(F.col("was").alias("node"), F.col("now").alias("component"))
    final = known.union(extra)
    # classes meet their components before rows meet their classes, so no join is keyed by what a group of copies shares
    settled = cut(classes.join(final, F.col("rep") == F.col("node"), "left").select("h1", "h2", "copies", F.coalesce("component", "rep").alias("component")))
    members = spread_join(sigs.select("doc_id", "n_shingles", "h1", "h2"), settled, ["h1", "h2"], "copies")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return members.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """Drop every document that is not its group's smallest doc_id; rows with a null doc_id stay."""
    gone = near_duplicates(docs, width, per_cent).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
