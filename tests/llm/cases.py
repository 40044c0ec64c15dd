"""Small tables with the cases that every operator must take, and plain versions of the contracts' words."""

import re
import zlib

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

BASE = "the quick brown fox jumps over the lazy dog while a calm river runs past the old stone mill and nobody in the village cares"
LONG = " ".join(f"word{i % 997} it's {i} über\tniño" for i in range(12_000))

TEXTS = [
    None, "", " \n\t ", BASE, BASE, BASE + " today", BASE.upper(), "two words", "Two  WORDS", "\n\n\n", "a shared line of text here\nown line number one", "A SHARED line of text here \nsomething else entirely",
    "1234 5678", "!!! ???", "Ünïcödé straße 日本語 テスト 🎉 ё", "I'll we've they're don't 's 're x'llama 'revenge", "tabs\tand\r\nreturns\x0b\x0c", "ends <|endoftext|> inside <s> </s> <unk> <0x41>", LONG, "x" * 5000, "ßßß ▁ ▁▁ mark", "a b c​d", "\x00nul",
]


def docs(spark, texts=TEXTS, extra=False, repeat=True):
    rows = [(i + 1, t, ["en", "de", None, "fr"][i % 4], "web", None if t is None else len(t)) for i, t in enumerate(texts)]
    if repeat:
        rows += [rows[min(3, len(rows) - 1)], (None, BASE, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("rep", "key", "id", "v", "a", "b", "hash", "n", "component", "size", "shard", "slot", "n_lines", "piece", "part", "score", "__bucket", "__row", "__gone", "keeper", "toxic", "held_out"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    """A-Z lowered, runs of anything but the six ASCII blanks."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text, width):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def fetch(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
