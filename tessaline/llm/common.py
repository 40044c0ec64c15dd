"""Helpers that several operators share: lineage cuts, batching, Arrow building."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points handled at once by the vectorised text scanners; bounds a worker's memory.
SLICE_CHARS = 1 << 20
#: The same for scanners that keep several numbers for each byte.
MODEL_CHARS = 1 << 18
#: Bytes of an Arrow batch of texts, of one row at least; Spark's own default holds eight times as many at both ends.
BATCH_BYTES = 8 << 20
#: Bounds of `Memo`.
MEMO_CHARS, LONG_WORD = 8 << 20, 256
#: A key with more than 1 / HOT of all rows is hot; there are fewer than HOT of them, whatever the data.
HOT = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: list[str], name: str) -> str:
    """A column name like `name` that is not among those taken (upper and lower case are one name)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Honour spark.checkpoint.dir; a folder of our own only where it is unset (tests, local runs)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessaline-checkpoint-"))


def bound_batches(df: DataFrame) -> DataFrame:
    """`df`, whose session hands Python batches of BATCH_BYTES from now on, where it still had Spark's default."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, "67108864b") in ("67108864b", "67108864", "64m", "64MB"):
        conf.set(name, f"{BATCH_BYTES}b")
    return df


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and drop its lineage; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Memo:
    """Values of words met lately, in two generations: words in use outlive rare ones.

    A generation ends at `limit` entries or MEMO_CHARS characters of keys; words longer than LONG_WORD aren't kept,
    so a corpus of huge unique words can't fill a worker.
    """

    def __init__(self, limit: int):
        self.limit, self.now, self.old, self.chars = limit, {}, {}, 0

    def __reduce__(self):
        return Memo, (self.limit,)

    def of(self, words: Iterable[str], make: Callable[[list[str]], Iterable]) -> dict:
        """{word: value} of distinct words; `make` gives the values of those not kept."""
        now, old = self.now, self.old
        found = {w: now.get(w) for w in words}
        lost = [w for w, v in found.items() if v is None]
        if lost:
            again = {w: v for w in lost if (v := old.get(w)) is not None}
            new = [w for w in lost if w not in again]
            if new:
                again.update(zip(new, make(new)))
            found.update(again)
            kept = {w: v for w, v in again.items() if len(w) <= LONG_WORD}
            chars = sum(map(len, kept))
            if now and (len(now) + len(kept) > self.limit or self.chars + chars > MEMO_CHARS):
                self.now, self.old, self.chars = kept, now, chars
            else:
                now.update(kept)
                self.chars += chars
        return found


def spread_join(left: DataFrame, facts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """left LEFT JOIN facts on two 64-bit `keys`, for facts with one row a key and, in column `n`, the rows that share it.

    Facts of hot keys are broadcast: a key is hot with more than a HOT-th of the sum of n, so there are fewer than HOT
    of them.  Rows that find theirs there go on under scattered keys; all others meet their facts in a shuffled join in
    which no key has more than a HOT-th of the rows.  `facts` is read three times: give a stored or checkpointed table.
    `left` must be narrow over stored rows, so that a task that runs again scatters alike.
    """
    total = facts.agg(F.sum(n)).first()[0] or 0
    names = [c for c in facts.columns if c not in keys]
    hot_of, cold_of = ({c: f"__{kind}_{i}" for i, c in enumerate([*keys, *names])} for kind in ("hot", "cold"))
    hot = F.broadcast(facts.where(F.col(n) * HOT > total).select(*[F.col(c).alias(hot_of[c]) for c in facts.columns]))
    cold = facts.where(F.col(n) * HOT <= total).select(*[F.col(c).alias(cold_of[c]) for c in facts.columns])
    met = left.join(hot, [F.col(k) == F.col(hot_of[k]) for k in keys], "left")
    own = F.col(hot_of[keys[0]]).isNotNull()
    scattered = [F.when(own, F.xxhash64(F.lit(i), F.monotonically_increasing_id())).otherwise(F.col(k)).alias(f"__at_{i}") for i, k in enumerate(keys)]
    met = met.select("*", *scattered).join(cold, [F.col(f"__at_{i}") == F.col(cold_of[k]) for i, k in enumerate(keys)], "left")
    return met.select(*[F.col(f"`{c}`") for c in left.columns], *[F.when(own, F.col(hot_of[c])).otherwise(F.col(cold_of[c])).alias(c) for c in names])


def stored(df: DataFrame) -> DataFrame:
    """Like `cut`, as compressed Parquet in the shared checkpoint folder: for wide or long intermediate tables.

    The files stay until the folder is emptied, as plans made from them may run at any later time.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(texts: list[str | None] | pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) runs of about `limit` characters; null counts as empty, long texts stand alone.

    Of an Arrow column only the texts of one run are held as Python strings.
    """
    first, size, run = 0, 0, []
    for i, t in enumerate(texts):
        t = (t.as_py() if isinstance(t, pa.Scalar) else t) or ""
        if run and size + len(t) > limit:
            yield first, run
            first, size, run = i, 0, []
        run.append(t)
        size += len(t)
    if run:
        yield first, run


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and len(texts)+1 offsets into them."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return joined, np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def trim() -> None:
    """Give freed memory back to the system: a worker that waits stays alive beside those that work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task function, which trims its worker when it ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped
