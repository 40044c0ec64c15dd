"""Two-pass external shuffle into shards (operator 9), on DataFrame functions alone.

Pass 1 scatters records into buckets of about `bucket_bytes` by a seeded hash;
pass 2 gathers a bucket in memory, permutes it with Spark's `shuffle`, which is
a seeded Fisher-Yates shuffle of an array, and lays the buckets end to end.
Shard i of n is rows floor(i*N/n) to floor((i+1)*N/n) of that order, so shard
sizes are at most one row apart (law `rows`).

The hash takes the row's place in its input partition besides the key, so rows
that repeat a key a million times scatter like others and no bucket grows with
a hot key.  Bucket starts are two-level prefix sums over counts of buckets.

Defined results: a null text has size 1 and the checksum of the empty text; a
null key is a key like others; repeated rows are kept; an empty table gives no
rows; with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BYTES = 32 << 20
GROUP = 4096  # buckets whose starts one task sums


def bucket_count(rows: DataFrame, bucket_bytes: int, size: Column) -> int:
    """Buckets so that each holds about `bucket_bytes`: one aggregate row comes back."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    return max(1, -(-int(total) // bucket_bytes))


def scatter(rows: DataFrame, key: str, buckets: int, seed: int) -> DataFrame:
    """Pass 1: (bucket, key, row), a bucket number for each row, uniform whatever the keys are."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
    return rows.select(bucket.alias("bucket"), F.col(key).alias("key"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))


def permute(scattered: DataFrame, starts: DataFrame, buckets: int, seed: int) -> DataFrame:
    """Pass 2: Fisher-Yates within each bucket; columns row, pos (the bucket's start plus the place in it), total.

    Rows are sorted before they are permuted, so that a task that runs again draws the same.  A bucket's start travels
    to it as a row of its own: records move once, and no join meets them.
    """
    marks = starts.select(F.col("own").alias("bucket"), F.lit(None).cast(scattered.schema["key"].dataType).alias("key"), F.lit(None).cast(scattered.schema["row"].dataType).alias("row"), "start", "total")
    both = scattered.select("bucket", "key", "row", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("total")).union(marks)
    entry = F.when(F.col("row").isNotNull(), F.struct("key", F.xxhash64("row").alias("tie"), "row"))
    # a task for each bucket, dealt before rows are grouped: no map task holds rows of many buckets
    gathered = both.repartitionById(buckets, F.col("bucket")).groupBy("bucket").agg(F.collect_list(entry).alias("rows"), F.max("start").alias("start"), F.max("total").alias("total")).sortWithinPartitions("bucket")
    drawn = gathered.select("start", "total", F.shuffle(F.transform(F.array_sort("rows"), lambda r: r["row"]), seed).alias("rows"))
    return drawn.select("start", "total", F.posexplode("rows").alias("at", "row")).select("row", (F.col("start") + F.col("at")).alias("pos"), "total")


def bucket_starts(counts: DataFrame) -> DataFrame:
    """(own, start, total): prefix sums within groups of buckets, then over the groups."""
    dealt = counts.withColumn("group", F.floor(F.col("bucket") / GROUP))
    groups = dealt.groupBy("group").agg(F.sum("n").alias("n"))
    over = Window.orderBy("group")  # a row for each GROUP buckets
    starts = groups.select("group", (F.sum("n").over(over) - F.col("n")).alias("base"), F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    within = F.sum("n").over(Window.partitionBy("group").orderBy("bucket")) - F.col("n")
    return dealt.select(F.col("bucket").alias("own"), "group", within.alias("within")).join(starts, "group").select("own", (F.col("base") + F.col("within")).alias("start"), "total")


def shuffle_shards(rows: DataFrame, key: str, size: Column, shards: int = 16, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The input's columns, then shard int and slot long (input columns of those names are replaced), in a seeded uniform order."""
    buckets = bucket_count(rows, bucket_bytes, size)
    scattered = scatter(rows, key, buckets, seed)
    starts = bucket_starts(scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    numbered = permute(scattered, starts, buckets, seed).withColumn("nth", F.expr(f"({shards} * (pos + 1) + total - 1) DIV total - 1"))
    own = [F.col(f"row.`{c}`") for c in rows.columns if c.lower() not in ("shard", "slot")]
    return numbered.select(*own, F.col("nth").cast("int").alias("shard"), F.expr(f"pos - nth * total DIV {shards}").cast("long").alias("slot"))


def write_shards(rows: DataFrame, path: str, key: str, size: Column, shards: int = 16, seed: int = 17) -> None:
    """Parquet, one folder per shard, rows of a folder in slot order across its files."""
    out = shuffle_shards(rows, key, size, shards, seed)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
