"""Line dedup (operator 10), on DataFrame functions alone.

Lines are exploded and hashed after normalising; a hash held by at least
`min_docs` distinct documents is frequent.  A frequent line stays only in the
smallest doc_id that holds it.  Hash rows are 16 bytes and a document number,
aggregated on the map side, so a line that a third of the corpus shares costs
one row per map task.  Lines meet their keeper in a join that broadcasts the
few hot hashes (`spread_join`).  Only the places of lost lines travel back, and
the texts are moved once, to meet them; a text is put together again by
position, in time linear in its lines.

Defined results: null and empty texts are one empty line; rows that repeat a
doc_id count as one document and are cut alike; rows with a null doc_id never
make a line frequent and lose nothing; an empty table gives no rows; other
columns pass through untouched and cannot clash (working names avoid theirs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import fresh, spread_join, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 10, 2


def line_key(line: Column) -> Column:
    """A-Z lower-cased, ASCII blanks off both ends; pure ASCII lines take the fast lower()."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hashes(lines: Column, min_chars: int) -> Column:
    """128 bits of each line's key, in order; null for keys that are too short to count."""
    return F.transform(F.transform(lines, line_key), lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(7), k).alias("b"))))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def exploded(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, same, pos, a, b): the lines that count, with their place and a hash of the whole text."""
    lines = F.posexplode(line_hashes(lines_of(F.col("text")), min_chars)).alias("pos", "hash")
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("same"), lines).where("hash IS NOT NULL").select("doc_id", "same", "pos", "hash.a", "hash.b")


def frequent_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(a, b, keeper, n): hashes in at least `min_docs` distinct documents, the smallest doc_id with them, and how many lines have them."""
    lines = exploded(docs, min_chars).select("doc_id", "a", "b")
    if min_docs == 2:  # two distinct documents: the smallest and the largest differ
        return lines.groupBy("a", "b").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("keeper < last").select("a", "b", "keeper", "n")
    distinct = lines.groupBy("a", "b", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy("a", "b").agg(F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= min_docs).select("a", "b", "keeper", "n")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, same, gone): for every text that loses lines, their places."""
    met = spread_join(exploded(docs, min_chars), stored(frequent_lines(docs, min_chars, min_docs)), ["a", "b"], "n")
    return met.where("doc_id > keeper").groupBy("doc_id", "same").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The input's columns with `text` cut, then n_lines and n_dropped (an input column of those names is replaced)."""
    gone_id, gone_same, gone, rest = (fresh(docs.columns, c) for c in ("gone_id", "gone_same", "gone_lines", "kept_lines"))
    lost = dropped_lines(docs.select("doc_id", "text"), min_chars, min_docs).select(F.col("doc_id").alias(gone_id), F.col("same").alias(gone_same), F.col("gone").alias(gone))
    # the text is split once, into a variable of the outer transform; the places that stay are a set difference in order
    staying = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(gone)), lambda p: F.get(ls, p))
    cut = F.col(gone).isNotNull()
    out = docs.join(lost, [F.col("doc_id") == F.col(gone_id), F.xxhash64("text") == F.col(gone_same)], "left").withColumn(rest, F.when(cut, F.transform(F.array(lines_of(F.col("text"))), staying)[0]))
    n = F.size(lines_of(F.col("text"))).cast("long")
    columns = [F.when(cut, F.array_join(rest, "\n")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*columns, n.alias("n_lines"), F.when(cut, F.size(gone)).otherwise(0).cast("long").alias("n_dropped"))
