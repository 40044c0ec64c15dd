"""Toxicity from class-conditional Kneser-Ney models (operator 8).

Two models of how words are spelt, one of toxic and one of ordinary documents,
predict each byte of a word from the five before it (the word's start
included).  Each takes modified Kneser-Ney discounts, estimated from its own
counts of counts, and gives what it took, and the weight of PRIOR documents, to
one distribution that both share: a Kneser-Ney model of the two classes'
pooled counts, which itself backs off to continuation counts of shorter
contexts.  An expression that is rare in both classes is therefore scored alike
by both, and only what one class says markedly more often tells them apart.
Counts are of documents, not of occurrences, so a document that repeats itself
counts once.

A text's score compares the two log-likelihoods of every word of the whole text
and takes the mean over the SHARE of its words that speaks most for the toxic
class, normalised by their number: so many insults among so many words count
alike in short and long texts (a mean over all words can't tell a few insults
among thousands of words from the offset between languages).  A one-dimensional
logistic curve turns it into 0..1.  The curve is fitted on all labelled
documents of the sample, each scored by models that have not seen its fold.

Learning takes a bounded sample of labelled rows, at most about `max_toxic` and
`max_ordinary` documents drawn by a hash of doc_id, distinct texts only.  Words
are counted on the executors; the driver sees word counts of the sample.

Defined results: null and empty texts and texts without words get the score of
no evidence; rows with a null doc_id are not learned from and not held out;
conflicting labels of a doc_id count as toxic; with one class or none learned
every score is 0; repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import MODEL_CHARS, Memo, batch, bound_batches, cut, slices, tidy
from tessaline.llm.language_id import held_out
from tessaline.llm.ngrams import KeyIndex, grams, padded_bytes

SPAN = 6  # bytes of an n-gram
FOLDS = 4
DISCOUNT = 0.75  # of continuation counts
PRIOR = 20  # documents whose weight the shared distribution has in each context
SHARE = 0.03  # of a text's words: those that are held to be its evidence
MAX_TOXIC, MAX_ORDINARY = 4_000, 12_000
MEMO = 100_000
CHUNK = 50_000  # words whose n-grams are held at once while counting
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of all words, which word each is of, and the words' bounds among them."""
    joined, at = padded_bytes([f" {w} ".encode() for w in words], SPAN - 1)
    lengths = np.diff(at) - (SPAN - 1)
    owner = np.repeat(np.arange(len(words)), lengths)
    real = np.ones(len(joined), bool)
    for i in range(SPAN - 1):
        real[at[:-1] - SPAN + 1 + i] = False
    return grams(joined, SPAN)[real], owner, np.concatenate([[0], np.cumsum(lengths)])


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, inverse = np.unique(keys, return_inverse=True)
    return found, np.bincount(inverse, values, minlength=len(found)), inverse


def pooled_grams(words: list[str] | pa.Array, toxic: np.ndarray, ordinary: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """All n-grams that either class has, and their counts in each; words are spelt out a chunk at a time."""
    keys, counts = np.zeros(0, np.uint64), np.zeros((2, 0))
    for i in range(0, len(words), CHUNK):
        part = words[i : i + CHUNK]
        key, owner, _ = word_grams(part.to_pylist() if isinstance(part, pa.Array) else part)
        own, inverse = np.unique(key, return_inverse=True)
        new = np.stack([np.bincount(inverse, n[i : i + CHUNK][owner].astype(float), minlength=len(own)) for n in (toxic, ordinary)])
        merged, inverse = np.unique(np.concatenate([keys, own]), return_inverse=True)
        both = np.hstack([counts, new])
        keys, counts = merged, np.stack([np.bincount(inverse, c, minlength=len(merged)) for c in both])
    now = counts.sum(axis=0) > 0
    return keys[now], [c[now] for c in counts]


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts of one, two, and more, from the counts of counts; each at least 0 and below its count."""
    c = [float((n == k).sum()) for k in (1, 2, 3, 4)]
    share = c[0] / (c[0] + 2 * c[1]) if c[0] else 0.0
    raw = [k - (k + 1) * share * c[k] / c[k - 1] if c[k - 1] else 0.0 for k in (1, 2, 3)]
    return tuple(min(max(d, 0.0), k - 0.01) for d, k in zip(raw, (1, 2, 3)))


def smoothed(n: np.ndarray, of: np.ndarray, base: np.ndarray, prior: float = 0.0) -> np.ndarray:
    """P(last byte | context) of each n-gram with counts n: discounted counts, and `base` with what the discounts free and `prior` counts more."""
    first, second, more = discounts(n)
    taken = np.select([n <= 0, n < 1.5, n < 2.5], [0, first, second], more)
    total, freed = np.bincount(of, n) + prior, np.bincount(of, taken) + prior
    weight = np.where(total > 0, freed / np.maximum(total, 1e-9), 1.0)
    return np.where(total[of] > 0, (n - taken) / np.maximum(total[of], 1e-9), 0) + weight[of] * base


class KneserNey:
    """Log ratio of the two classes for every n-gram; an n-gram that neither has is the shared model's alone, ratio 0."""

    def __init__(self, words: list[str] | pa.Array, toxic: np.ndarray, ordinary: np.ndarray):
        pooled, classes = pooled_grams(words, toxic, ordinary)
        low = lambda k, n: k & np.uint64((1 << 8 * n) - 1)
        # shared backoff: continuation counts over both classes, two levels down to near-uniform bytes
        five, n5, at5 = _sums(low(pooled, SPAN - 1), np.ones(len(pooled)))
        four, n4, at4 = _sums(low(five, SPAN - 2), np.ones(len(five)))
        _, all4, of4 = _sums(four >> np.uint64(8), n4)
        base = ((n4 + 0.5) / (all4[of4] + 128))[at4]
        _, all5, of5 = _sums(five >> np.uint64(8), n5)
        kinds5 = np.bincount(of5)
        shorter = (np.maximum(n5 - DISCOUNT, 0) / all5[of5] + DISCOUNT * kinds5[of5] / all5[of5] * base)[at5]
        of = np.unique(pooled >> np.uint64(8), return_inverse=True)[1]
        shared = smoothed(classes[0] + classes[1], of, shorter)
        toxic_p, ordinary_p = (smoothed(n, of, shared, PRIOR) for n in classes)
        self.index, self.ratio = KeyIndex(pooled), np.log(toxic_p / ordinary_p).astype(np.float32)

    def word_ratios(self, words: list[str]) -> np.ndarray:
        key, _, bounds = word_grams(words)
        place = self.index.find(key)
        out = np.where(place >= 0, self.ratio[place], np.float32(0))
        return np.add.reduceat(out, bounds[:-1], dtype=np.float64)


def strongest_share(ratios: np.ndarray, share: float = SHARE) -> float:
    """Mean of the largest `share` of the words' ratios, of one at least; no words, no evidence."""
    if not len(ratios):
        return 0.0
    k = math.ceil(share * len(ratios))
    return float(np.partition(ratios, -k)[-k:].mean())


class Scorer:
    """A model with its calibration; keeps the ratios of words already met (bounded)."""

    def __init__(self, model: KneserNey | None, slope: float = 1.0, middle: float = 0.0):
        self.model, self.slope, self.middle = model, slope, middle
        self.memo = Memo(MEMO)

    def evidence(self, texts: list[str]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        ratio = self.memo.of({w for ws in split for w in ws}, lambda new: self.model.word_ratios(new).tolist())
        return np.array([strongest_share(np.array([ratio[w] for w in ws])) for ws in split])

    def score(self, texts: list[str]) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.evidence(texts) - self.middle), -40, 40)))


def calibrate(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic curve, classes weighing the same, with a slight pull to flat."""
    if not toxic.any() or toxic.all():
        return 1.0, (float(evidence.max()) + 1 if len(evidence) and not toxic.any() else 0.0)
    centre, spread = evidence.mean(), evidence.std() or 1.0
    x, w = (evidence - centre) / spread, np.where(toxic, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))
    design, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (w * (p - toxic)) + np.array([1e-2 * beta[0], 0])
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-9])
        beta -= np.clip(np.linalg.solve(hessian, gradient), -5, 5)
    if beta[0] <= 0:
        return 1.0, float(centre)
    return float(beta[0] / spread), float(centre - spread * beta[1] / beta[0])


def sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_ordinary: int) -> DataFrame:
    """(text, toxic, fold): distinct labelled texts, at most about the given numbers of each class."""
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    found = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {1: max_toxic / max(1, found.get(1, 0)), 0: max_ordinary / max(1, found.get(0, 0))}
    drawn = F.pmod(F.xxhash64(F.lit("toxicity sample"), "doc_id"), F.lit(1 << 30))
    few = own.where(drawn < F.when(F.col("toxic") == 1, int(min(1, share[1]) * (1 << 30))).otherwise(int(min(1, share[0]) * (1 << 30))))
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most about max_toxic + max_ordinary rows
    same = F.xxhash64("text")
    return texts.groupBy(same.alias("same")).agg(F.max(F.struct("toxic", "text")).alias("row")).select("row.text", "row.toxic", F.pmod("same", F.lit(FOLDS)).cast("int").alias("fold"))


COUNTED = pa.schema([("word", pa.string()), ("kind", pa.int32()), ("n", pa.int64())])


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, kind, n): documents that hold each word, kind = 2 * fold + toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, int]] = Counter()
        for b in batches:
            for text, toxic, fold in zip(*(c.to_pylist() for c in b.columns)):
                seen.update((w, 2 * fold + toxic) for w in set(words_of(text)))
        if seen:
            yield batch(COUNTED, [[k[0] for k in seen], [k[1] for k in seen], list(seen.values())])

    return bound_batches(rows).select("text", "toxic", "fold").mapInArrow(tidy(run), "word string, kind int, n long").groupBy("word", "kind").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> Scorer:
    """A calibration in which models of three folds score the fourth, in turn; then counts on all folds."""
    rows = cut(sample(docs, labels, max_toxic, max_ordinary))
    counts = word_counts(rows).toArrow()
    kinds, n = counts.column("kind").to_numpy(), counts.column("n").to_numpy()
    coded = counts.column("word").combine_chunks().dictionary_encode()
    of, every = coded.indices.to_numpy(), coded.dictionary
    table = np.zeros((2 * FOLDS, len(every)), np.float32)
    table[kinds, of] = n
    ordinary, toxic = table[0::2].sum(axis=0), table[1::2].sum(axis=0)
    if not ordinary.any() or not toxic.any():
        return Scorer(None)
    seen: list[pa.Table] = []
    for fold in range(FOLDS):
        most, least = toxic - table[2 * fold + 1], ordinary - table[2 * fold]
        if not most.any() or not least.any():  # a class lies in this fold alone: its model has to know it
            most, least = toxic, ordinary
        shared = docs.sparkSession.sparkContext.broadcast(Scorer(KneserNey(every, most, least)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for first, texts in slices(b.column(0), MODEL_CHARS):
                    yield pa.RecordBatch.from_arrays([b.column(1).slice(first, len(texts)), pa.array(shared.value.evidence(texts))], ["toxic", "evidence"])

        seen.append(rows.where(F.col("fold") == fold).select("text", "toxic").mapInArrow(tidy(run), "toxic int, evidence double").toArrow())
        shared.unpersist()
    found = pa.concat_tables(seen)
    return Scorer(KneserNey(every, toxic, ordinary), *calibrate(found.column("evidence").to_numpy(), found.column("toxic").to_numpy() == 1))


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, scorer: Scorer, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted; one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in slices(b.column(2), MODEL_CHARS):
                n, got = len(texts), shared.value.score(texts)
                yield batch(SCORED, [b.column(0).slice(first, n), b.column(1).slice(first, n), got, (got >= 0.5).astype(np.int32)])

    return bound_batches(docs).select(F.col("doc_id").cast("long"), held_out(F.col("doc_id"), folds, fold).alias("held_out"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def detect(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, **bounds: int) -> DataFrame:
    """Learn from labelled rows outside the fold, score all rows."""
    return score(docs, learn(docs, labels.where(~held_out(F.col("doc_id"), folds, fold)), **bounds), folds, fold)


def keep_ordinary(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """Drop documents scored 0.5 or more; texts and other columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, **bounds))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.concatenate([shared.value.score(t) for _, t in slices(b.column(at), MODEL_CHARS)] or [np.zeros(0)]) < 0.5
            if keep.any():
                yield b.filter(pa.array(keep))

    return bound_batches(docs).mapInArrow(tidy(run), docs.schema)
