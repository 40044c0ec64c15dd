import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessaline.llm.common import table
from tessaline.llm.queries import op8_toxicity
from tessaline.llm.toxicity import DISCOUNT, PRIOR, SPAN, KneserNey, calibrate, detect, keep_ordinary, strongest_share
from tests.llm import cases


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1.0
    for s in np.unique(score):
        order[score == s] = order[score == s].mean()
    pos = label.sum()
    return (order[label == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(label) - pos))


def test_rare_expressions_tell_nothing():
    model = KneserNey(["calm", "river", "idiot", "moron"], np.array([1, 1, 90, 80.0]), np.array([95, 90, 0, 1.0]))
    calm, idiot, new = model.word_ratios(["calm", "idiot", "xyzzy"])
    assert calm < 0 < idiot and abs(new) < min(-calm, idiot)


def plain_ratios(words, toxic, ordinary):
    """{word: log ratio} by dictionaries over strings of bytes, one n-gram at a time."""
    def spelt(w, n=SPAN):
        text = b"\0" * (SPAN - 1) + f" {w} ".encode()
        return [text[i - n + 1 : i + 1] for i in range(SPAN - 1, len(text))]

    counts = [defaultdict(float), defaultdict(float)]
    for w, *ns in zip(words, toxic, ordinary):
        for g in spelt(w):
            for c, n in zip(counts, ns):
                c[g] += n
    grams = {g for c in counts for g in c if c[g]}
    five = Counter(g[1:] for g in grams)
    four = Counter(g[1:] for g in five)

    def shorter(g):
        at4 = {h: n for h, n in four.items() if h[:-1] == g[2:-1]}
        base = (four[g[2:]] + 0.5) / (sum(at4.values()) + 128)
        at5 = {h: n for h, n in five.items() if h[:-1] == g[1:-1]}
        return max(five[g[1:]] - DISCOUNT, 0) / sum(at5.values()) + DISCOUNT * len(at5) / sum(at5.values()) * base

    def discount(c):
        of = Counter(n for g, n in c.items() if g in grams)
        share = of[1] / (of[1] + 2 * of[2]) if of[1] else 0
        d = {k: min(max(k - (k + 1) * share * of[k + 1] / of[k], 0), k - 0.01) if of[k] else 0 for k in (1, 2, 3)}
        return lambda n: d[min(int(n), 3)] if n else 0

    def probability(c, g, base, prior):
        d, near = discount(c), [h for h in grams if h[:-1] == g[:-1]]
        total = sum(c[h] for h in near) + prior
        return (c[g] - d(c[g]) + (sum(d(c[h]) for h in near) + prior) * base) / total

    pooled = defaultdict(float, {g: counts[0][g] + counts[1][g] for g in grams})
    out = {}
    for w in words:
        out[w] = 0.0
        for g in spelt(w):
            shared = probability(pooled, g, shorter(g), 0)
            out[w] += math.log(probability(counts[0], g, shared, PRIOR) / probability(counts[1], g, shared, PRIOR))
    return out


def test_probabilities_against_a_plain_version():
    words = ["calm", "calmer", "river", "rivers", "idiot", "idiots", "moron", "über"]
    toxic, ordinary = [3, 1, 2, 0, 9, 2, 4, 1], [8, 2, 7, 3, 0, 0, 1, 2]
    got = KneserNey(words, np.array(toxic, float), np.array(ordinary, float)).word_ratios(words)
    want = plain_ratios(words, toxic, ordinary)
    assert np.allclose(got, [want[w] for w in words], atol=1e-4)


def test_strongest_share():
    assert strongest_share(np.array([])) == 0 and strongest_share(np.array([-4.0])) == -4
    assert strongest_share(np.array([1.0, -5, 3, 4, -9]), 0.4) == 3.5
    assert strongest_share(np.array([1.0, -5, 3, 4, -9]), 0.01) == 4


def test_calibration_rises_with_evidence():
    slope, middle = calibrate(np.array([0.0, 0.1, 0.2, 2.0, 2.1]), np.array([False, False, False, True, True]))
    assert slope > 0 and 0.2 < middle < 2


def test_query(spark):
    sf_dir = "/root/testdata/sf0.1"  # hundreds of toxic texts to learn from
    if not os.path.isdir(sf_dir):
        pytest.skip("the tables are not here")
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf_dir, "labels").collect()}
    rows = cases.fetch(op8_toxicity(spark, sf_dir), "doc_id", "held_out", "score", "predicted")
    assert len(rows) == table(spark, sf_dir, "documents").count()
    for doc, held, score, predicted in rows:
        assert held == (cases.fold(doc, 5) == 0) and 0 <= score <= 1 and predicted == (score >= 0.5)
    own = [(s, labels[d]) for d, h, s, _ in rows if h and d in labels]
    score, label = np.array([s for s, _ in own]), np.array([t for _, t in own])
    assert auc(score, label) > 0.95 and ((score >= 0.5) == label).mean() > 0.9


def test_long_clean_texts_are_left_alone(spark):
    sf_dir = "/root/testdata/sf0.1"
    if not os.path.isdir(sf_dir):
        pytest.skip("the tables are not here")
    clean = table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id")
    long = table(spark, sf_dir, "documents").where("length(text) >= 5000").select("doc_id").join(clean, "doc_id", "left_semi")
    got = cases.fetch(op8_toxicity(spark, sf_dir).where("held_out").join(long, "doc_id", "left_semi"), "predicted")
    assert len(got) > 50 and sum(p for (p,) in got) <= 0.05 * len(got)


def test_odd_rows(spark):
    texts = [*cases.TEXTS, *[f"you are an utter idiot and a moron number {i}" for i in range(20)], *[f"what a calm and pleasant day number {i}" for i in range(20)]]
    n = len(cases.TEXTS)
    labels = spark.createDataFrame([(i + 1, None, int(n < i + 1 <= n + 20)) for i in range(n, n + 40)] + [(n + 1, None, 0), (None, None, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = cases.fetch(detect(cases.docs(spark, texts, extra=True), labels), "doc_id", "held_out", "score", "predicted")
    assert len(got) == len(texts) + 3
    by = {d: s for d, _, s, _ in got if d}
    assert by[1] == by[2] == by[3] and by[4] == by[5]
    assert all(by[n + 1 + i] > 0.5 > by[n + 21 + i] for i in range(20))
    df = cases.docs(spark, texts, extra=True)
    kept = keep_ordinary(df, labels)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} & set(range(n + 1, n + 21)) == set()
    assert detect(cases.empty(spark), labels).count() == 0 and keep_ordinary(cases.empty(spark), labels).count() == 0
    one_class = detect(cases.docs(spark, texts), labels.where("toxic = 0"))
    assert {r["score"] for r in one_class.collect()} == {0.0}
