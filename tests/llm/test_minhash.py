import random
from itertools import combinations

import numpy as np
import pytest

from tessaline.llm import minhash
from tessaline.llm.common import table
from tessaline.llm.components import connected_components
from tessaline.llm.queries import op7_minhash_dedup
from tests.llm import cases


def plain(rows, width, per_cent):
    """{doc_id: (n_shingles, component)} by comparing all pairs."""
    sets = {d: cases.shingles(t, width) for d, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if (n := len(sets[a] & sets[b])) and 100 * n >= per_cent * len(sets[a] | sets[b])]
    found = cases.components(sets, links)
    return {d: (len(s), found[d]) for d, s in sets.items()}


def hold(df, want):
    rows = cases.fetch(df, "doc_id", "n_shingles", "component_id", "kept")
    assert {d: (n, c) for d, n, c, _ in rows if d is not None} == want
    assert all(k == (d is not None and d == c) for d, _, c, k in rows)
    return rows


def test_query(spark, sf_dir):
    rows = cases.fetch(table(spark, sf_dir, "documents"), "doc_id", "text")
    want = plain(rows, 3, 85)
    assert any(c != d for d, (_, c) in want.items())
    hold(op7_minhash_dedup(spark, sf_dir), want)


@pytest.mark.parametrize(("width", "per_cent"), [(3, 85), (5, 80)])
def test_chains_and_large_groups(spark, width, per_cent):
    """Slowly changing texts: neighbours link, ends don't; many near copies of one text; and bystanders."""
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(4000)]
    text = rng.choices(vocabulary, k=120)
    texts = []
    for _ in range(60):
        texts.append(" ".join(text))
        text = text[2:] + rng.choices(vocabulary, k=2)
    base = rng.choices(vocabulary, k=100)
    for _ in range(150):
        own = list(base)
        own[rng.randrange(100)] = rng.choice(vocabulary)
        texts.append(" ".join(own))
    texts += [" ".join(rng.choices(vocabulary, k=40)) for _ in range(60)]
    rng.shuffle(texts)
    df = cases.docs(spark, texts, repeat=False)
    hold(minhash.near_duplicates(df, width, per_cent), plain(cases.fetch(df, "doc_id", "text"), width, per_cent))


def test_second_look_finds_what_the_star_misses(spark, monkeypatch):
    """The bucket's head is far from two members that are near each other."""
    monkeypatch.setattr(minhash, "bands_for", lambda t: (16, 1))  # buckets hold texts that share little
    rng = random.Random(1)
    common, vocabulary = [f"c{i}" for i in range(60)], [f"w{i}" for i in range(900)]
    texts = [" ".join(common + rng.choices(vocabulary, k=40)) for _ in range(12)]
    texts += [texts[5] + " more", texts[9] + " yet more"]
    df = cases.docs(spark, texts, repeat=False)
    hold(minhash.near_duplicates(df, 3, 85), plain(cases.fetch(df, "doc_id", "text"), 3, 85))


def test_odd_rows(spark):
    df = cases.docs(spark, extra=True)
    rows = hold(minhash.near_duplicates(df, 3, 85), plain([(i + 1, t) for i, t in enumerate(cases.TEXTS)], 3, 85))
    assert len(rows) == len(cases.TEXTS) + 3
    assert {(c, k) for d, _, c, k in rows if d is None} == {(None, False)}
    kept = minhash.keep_one(df, 5, 80)
    assert kept.columns == df.columns and kept.where("doc_id IS NULL").count() == 2
    want = plain([(i + 1, t) for i, t in enumerate(cases.TEXTS)], 5, 80)
    assert {r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()} == {d for d, (_, c) in want.items() if d == c}
    assert minhash.near_duplicates(cases.empty(spark)).count() == 0 and minhash.keep_one(cases.empty(spark)).count() == 0


def test_pruning_keeps_likely_pairs():
    """At the threshold itself a true pair is hardly ever pruned."""
    rng, k = np.random.default_rng(0), 160
    right = rng.integers(0, 1 << 32, (4000, k), dtype=np.uint32)
    left = np.where(rng.random((4000, k)) < 0.85, right, right + np.uint32(1))
    i = np.arange(4000)
    assert len(minhash.survivors(left, right, i, i, 0.85, minhash.MISS)) >= 3999
    far = np.where(rng.random((4000, k)) < 0.3, right, right + np.uint32(1))
    assert len(minhash.survivors(far, right, i, i, 0.85, minhash.MISS)) == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(1, 200)] + [(1000, rng.randrange(2000, 2100)) for _ in range(80)] + [(rng.randrange(5000, 5060), rng.randrange(5000, 5060)) for _ in range(40)]
    nodes = {n for l in links if l[0] != l[1] for n in l}
    df = spark.createDataFrame(links, "x long, y long").repartition(7)
    assert dict(cases.fetch(connected_components(df, "x", "y"), "node", "component")) == cases.components(nodes, [l for l in links if l[0] != l[1]])
    assert connected_components(df.where("false"), "x", "y").count() == 0
