"""Language identification by prediction by partial matching (operator 3).

For each language a tree of byte contexts of up to ORDER bytes holds how often
each byte followed.  A byte's probability comes from the longest context that
was seen; when the byte was not seen there, the context's escape probability
(method C: distinct followers against occurrences) is paid and the next shorter
context is asked, down to a uniform byte.  Counts are frozen after learning, so
a text's code length under a language is exact and does not depend on order.

Frozen trees of all languages are merged into one table for each context
length: an n-gram leads to its resolved code length in every language at once,
and a context leads to its escape cost.  A text of n bytes takes n vectorised
lookups and, where they miss, lookups at shorter lengths; contexts run across
the whole text.

Learning takes a bounded sample: about `sample_bytes` of each language (less,
where there are so many labels that ALL_BYTES would be exceeded), drawn by a
hash of doc_id from all labelled rows (distinct texts only), and the document of
the smallest hash always, so every language that is labelled is learned.  The
model is at most a few MB for each language, whatever the corpus.

Defined results: null text and text without a letter are `und` with score 0;
rows with a null doc_id are not learned from and not held out; with no labelled
rows everything is `und`; repeated rows and ties (to the first language in
alphabetical order) are predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import MODEL_CHARS, batch, bound_batches, slices, tidy
from tessaline.llm.ngrams import KeyIndex, grams, padded_bytes

ORDER = 4
SAMPLE_BYTES = 1 << 20
ALL_BYTES = 1 << 26  # of the samples of all languages
MOST_BITS = 16.0  # a byte: twice the uniform code; a text above it in every language is in none of them
UNKNOWN = "und"


class Ppm:
    """Merged frozen context trees of several languages."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER):
        self.order, self.languages = order, sorted(samples)
        counted = []  # for each language and level: n-grams, counts
        for lang in self.languages:
            joined, at = padded_bytes([t.encode("utf-8", "surrogatepass") for t in samples[lang]], order)
            real = np.ones(len(joined), bool)
            for i in range(order):
                real[at[:-1] - order + i] = False
            counted.append([np.unique(grams(joined, k + 1)[real], return_counts=True) for k in range(order + 1)])
        self.levels: list[tuple[KeyIndex, np.ndarray, KeyIndex, np.ndarray]] = []
        for k in range(order + 1):
            union = np.unique(np.concatenate([c[k][0] for c in counted])) if counted else np.zeros(0, np.uint64)
            seen = np.unique(union >> np.uint64(8))
            cost, escape = np.zeros((len(union), len(counted))), np.zeros((len(seen), len(counted)))
            for l, c in enumerate(counted):
                keys, n = c[k]
                contexts, inverse = np.unique(keys >> np.uint64(8), return_inverse=True)
                times, kinds = np.bincount(inverse, n), np.bincount(inverse)
                escape[np.searchsorted(seen, contexts), l] = np.log2((times + kinds) / kinds)
                own = np.searchsorted(union, keys)
                unseen = np.ones(len(union), bool)
                unseen[own] = False
                cost[own, l] = np.log2((times + kinds)[inverse] / n)
                if unseen.any():
                    rest = union[unseen]
                    cost[unseen, l] = escape[np.searchsorted(seen, rest >> np.uint64(8)), l] + self._resolved(rest & np.uint64((1 << 8 * k) - 1), k - 1)[:, l]
            self.levels.append((KeyIndex(union), cost.astype(np.float32), KeyIndex(seen), escape.astype(np.float32)))

    def _resolved(self, gram: np.ndarray, level: int) -> np.ndarray:
        """Bits of the last byte of each (level+1)-gram, [n, languages]; level -1 is the uniform byte."""
        out = np.zeros((len(gram), len(self.languages)), np.float32)
        left = np.arange(len(gram))
        for k in range(level, -1, -1):
            index, cost, contexts, escape = self.levels[k]
            key = gram[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            place = index.find(key)
            found = place >= 0
            out[left[found]] += cost[place[found]]
            left, key = left[~found], key[~found]
            if not len(left):
                return out
            place = contexts.find(key >> np.uint64(8))
            known = place >= 0
            out[left[known]] += escape[place[known]]
        out[left] += 8
        return out

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each whole text under each language."""
        joined, at = padded_bytes([t.encode("utf-8", "surrogatepass") for t in texts], self.order)
        bits = self._resolved(grams(joined, self.order + 1), self.order)
        for i in range(self.order):
            bits[at[:-1] - self.order + i] = 0
        return np.add.reduceat(bits, at[:-1] - self.order, axis=0, dtype=np.float64)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        return self.chosen(texts, self.code_lengths(texts))

    def identified(self, texts: list[str], most_bits: float) -> np.ndarray:
        """Which texts have a letter and are coded in `most_bits` a byte by some language; with nothing learned, which have a letter."""
        letters = np.array([has_letter(t) for t in texts])
        if not self.languages:
            return letters
        return letters & (self.code_lengths(texts).min(axis=1) <= most_bits * np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts]))

    def chosen(self, texts: list[str], bits: np.ndarray) -> list[tuple[str, float]]:
        best = bits.argmin(axis=1)
        odds = np.exp2(np.clip(bits[np.arange(len(bits)), best][:, None] - bits, -1000, 0))
        return [(self.languages[b], float(1 / o)) if has_letter(t) else (UNKNOWN, 0.0) for t, b, o in zip(texts, best, odds.sum(axis=1))]


_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def learn(labelled: DataFrame, sample_bytes: int = SAMPLE_BYTES, order: int = ORDER) -> Ppm:
    """Fit on about `sample_bytes` of distinct texts of each language; columns doc_id, text, lang."""
    usable = labelled.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    drawn = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 30))
    found = usable.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.min(drawn).alias("first")).collect()  # a row for each label
    if not found:
        return Ppm({}, order)
    own = min(sample_bytes, max(1, ALL_BYTES // len(found)))
    until = {r["lang"]: max(int(min(1.0, own / max(1, r["bytes"])) * (1 << 30)), r["first"] + 1) for r in found}
    limits = F.create_map(*[F.lit(x) for kv in until.items() for x in kv])
    samples: dict[str, dict[str, None]] = {k: {} for k in until}
    for r in usable.where(drawn < limits[F.col("lang")]).select("lang", "text").toLocalIterator():
        samples[r["lang"]][r["text"]] = None
    return Ppm({k: sorted(v) for k, v in samples.items()}, order)


PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, model: Ppm, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score; one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in slices(b.column(2), MODEL_CHARS):
                n = len(texts)
                yield batch(PREDICTED, [b.column(0).slice(first, n), b.column(1).slice(first, n), *map(list, zip(*shared.value.predict(texts)))])

    return bound_batches(docs).select(F.col("doc_id").cast("long"), held_out(F.col("doc_id"), folds, fold).alias("held_out"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 3, fold: int = 1, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Learn from the rows outside the fold, predict all rows."""
    model = learn(docs.where(~held_out(F.col("doc_id"), folds, fold)), sample_bytes)
    return predict(docs, model, folds, fold)


def keep_identified(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, most_bits: float = MOST_BITS) -> DataFrame:
    """Drop documents in no learned language: those without a letter, and those whose shortest code takes over `most_bits` a byte.

    Where nothing is labelled, only documents without a letter go.  Texts and other columns stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, sample_bytes))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.concatenate([shared.value.identified(texts, most_bits) for _, texts in slices(b.column(at), MODEL_CHARS)] or [np.zeros(0, bool)])
            if keep.any():
                yield b.filter(pa.array(keep))

    return bound_batches(docs).mapInArrow(tidy(run), docs.schema)
