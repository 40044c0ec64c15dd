import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tessaline.llm.common import table
from tessaline.llm.queries import op9_shuffle_shards
from tessaline.llm.shuffle_shards import shuffle_shards, write_shards
from tests.llm import cases


def laid_out(rows, shards):
    """rows: (shard, slot); counts at most one apart, slots gapless from 0."""
    by = defaultdict(list)
    for shard, slot in rows:
        by[shard].append(slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    counts = [len(by.get(i, [])) for i in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    rows = cases.fetch(op9_shuffle_shards(spark, sf_dir), "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    assert sorted(r[0] for r in rows) == sorted(texts)
    for doc, size, crc, law, _, _, grown in rows:
        raw = (texts[doc] or "").encode()
        assert (size, crc, law, grown) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    laid_out([r[4:6] for r in rows], 16)
    assert rows and sorted(rows, key=lambda r: r[4:6]) != sorted(rows)  # an order of its own


def test_same_order_again_and_many_buckets(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.lit(100).cast("long").alias("size"))
    run = lambda seed: sorted(cases.fetch(shuffle_shards(df, "doc_id", F.col("size"), 7, seed, 1500), "shard", "slot", "doc_id"))
    one = run(3)
    laid_out([r[:2] for r in one], 7)
    assert one == run(3) != run(4)


def test_odd_rows(spark):
    for df in (cases.docs(spark, extra=True), cases.docs(spark, ["a"] * 500), cases.docs(spark, ["one", "two"], repeat=False)):
        rows = cases.fetch(shuffle_shards(df, "doc_id", F.octet_length(F.coalesce("text", F.lit(""))), 16, 1, 64), "shard", "slot")
        assert len(rows) == df.count()
        laid_out(rows, 16)
    assert shuffle_shards(cases.empty(spark), "doc_id", F.lit(1), 16).count() == 0


def test_files_hold_their_shard(spark, tmp_path):
    df = cases.docs(spark, [f"text {i}" for i in range(100)], repeat=False)
    write_shards(df, str(tmp_path / "out"), "doc_id", F.lit(10), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["shard"], r["count"]) for r in back.groupBy("shard").count().collect()} == {(i, 25) for i in range(4)}
    assert {(r["doc_id"], r["text"]) for r in back.collect()} == {(i + 1, f"text {i}") for i in range(100)}
    for shard in range(4):  # slots rise along the files of a folder and within each
        files = sorted((tmp_path / "out" / f"shard={shard}").glob("*.parquet"))
        slots = [r["slot"] for f in files for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(25))


def test_no_python_in_the_plan(spark, sf_dir):
    plan = op9_shuffle_shards(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
