import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaline.llm.common import table
from tessaline.llm.language_id import Ppm, has_letter, identify, keep_identified, learn
from tessaline.llm.queries import op3_language_id
from tests.llm import cases


def plain_bits(samples, text, order=4):
    """Code length by the textbook: longest seen context, escape by method C, down to a uniform byte."""
    follow = defaultdict(Counter)
    for s in samples:
        raw = b"\0" * order + s.encode()
        for i in range(order, len(raw)):
            for k in range(order + 1):
                follow[raw[i - k : i]][raw[i]] += 1
    raw, bits = b"\0" * order + text.encode(), 0.0
    for i in range(order, len(raw)):
        for k in range(order, -1, -1):
            seen = follow.get(raw[i - k : i])
            if seen is None:
                continue
            n, kinds = seen.total(), len(seen)
            if raw[i] in seen:
                bits += math.log2((n + kinds) / seen[raw[i]])
                break
            bits += math.log2((n + kinds) / kinds)
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    samples = {"a": ["abracadabra", "abacus and cab", "über"], "b": ["hokus pokus", "hop on pop", "abra"]}
    model = Ppm(samples)
    texts = ["abra", "hop", "zzz", "", "über alles", "abracadabra hokus"]
    got = model.code_lengths(texts)
    for t, row in zip(texts, got):
        for l, lang in enumerate(model.languages):
            assert row[l] == pytest.approx(plain_bits(samples[lang], t), abs=1e-3)


def test_lengths_do_not_depend_on_neighbours():
    model = Ppm({"a": ["the cat sat"], "b": ["der Hund lief"]})
    texts = ["cat", "Hund", "x" * 100, "sat"]
    assert np.allclose(model.code_lengths(texts), np.concatenate([model.code_lengths([t]) for t in texts]))


def test_query(spark, sf_dir):
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in table(spark, sf_dir, "documents").collect()}
    rows = cases.fetch(op3_language_id(spark, sf_dir), "doc_id", "held_out", "lang_pred", "score")
    assert sorted(r[0] for r in rows) == sorted(truth)
    learned = {lang for d, (lang, _) in truth.items() if lang and cases.fold(d, 3) != 1}
    right = asked = 0
    for doc, held, pred, score in rows:
        lang, text = truth[doc]
        assert held == (cases.fold(doc, 3) == 1) and 0 <= score <= 1
        assert (pred == "und") == (not any(c.isalpha() for c in text or "")) and pred in learned | {"und"}
        if held and lang and pred != "und":
            asked, right = asked + 1, right + (pred == lang)
    assert right >= 0.9 * asked > 0


def test_odd_rows(spark):
    got = cases.fetch(identify(cases.docs(spark, extra=True)), "doc_id", "held_out", "lang_pred", "score")
    assert len(got) == len(cases.TEXTS) + 3
    by = {d: (h, p, s) for d, h, p, s in got if d is not None}
    assert by[1][1:] == by[2][1:] == by[14][1:] == ("und", 0.0)
    assert by[4][1:] == by[5][1:] and all(not h for d, h, _, _ in got if d is None)
    assert identify(cases.empty(spark)).count() == 0
    nothing = identify(cases.docs(spark).drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang"))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    df = cases.docs(spark, extra=True)
    kept = keep_identified(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"]} == {i + 1 for i, t in enumerate(cases.TEXTS) if has_letter(t or "")}
    assert keep_identified(cases.empty(spark)).count() == 0


def test_rejection_rests_on_code_lengths(spark):
    known = [f"the river runs past the mill number {i} and the mill stands by the river" for i in range(40)]
    foreign = ["这是一个完全没有见过的语言的句子", "Это предложение на незнакомом языке"]
    df = cases.docs(spark, [*known, *foreign, "12 34 !"], repeat=False).withColumn("lang", F.when(F.col("doc_id") <= 40, "en"))
    assert {r["doc_id"] for r in keep_identified(df, most_bits=8).collect()} == set(range(1, 41))
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in keep_identified(unlabelled).collect()} == set(range(1, 43))


def test_every_labelled_language_is_learned(spark):
    """Three long documents of a language, far over the sample's share, and one short one of another."""
    df = cases.docs(spark, ["ein langer Text " * 500, "noch ein langer Text " * 500, "der dritte Text " * 500, "the short one"], repeat=False)
    df = df.withColumn("lang", F.when(F.col("doc_id") < 4, "de").otherwise("en"))
    assert learn(df, sample_bytes=10).languages == ["de", "en"]
