import numpy as np
from pyspark.sql import functions as F

from tessaline.llm import graph_dedup, ivfpq
from tessaline.llm.common import table
from tessaline.llm.queries import op4_graph_dedup, op6_ivfpq_search
from tests.llm import cases


def takes_part(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)


def plain_links(rows, radius):
    """{id: (links, component)} by comparing all pairs of (id, vector)."""
    own = [(i, v) for i, v in rows if takes_part(v)]
    ids, x = [i for i, _ in own], np.array([v for _, v in own], float)
    near = np.zeros((len(x), len(x)), bool)
    for k in range(len(x)):
        near[k] = (x @ x[k]) / (np.sqrt((x * x).sum(1)) * np.sqrt(x[k] @ x[k])) >= radius
    np.fill_diagonal(near, False)
    found = cases.components([i for i, _ in rows], [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    n = dict(zip(ids, near.sum(1).tolist()))
    return {i: (n.get(i, 0), found[i]) for i, _ in rows}


def vectors(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.withColumns({c: F.lit("clash") for c in ("id", "v", "h1", "h2", "rep", "shard", "mult", "list", "near")}) if extra else df


def clustered(n, groups, seed=0, d=16, noise=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    return centres[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, d))


ODD = [(1, None), (2, [0.0] * 8), (3, [None] + [1.0] * 7), (4, [float("nan")] + [1.0] * 7), (5, [float("inf")] + [1.0] * 7), (6, [1.0] * 8), (7, [2.0] * 8), (8, [1.0] * 8), (9, [1.0] * 7 + [1.1]), (10, [-1.0] * 8), (11, [1.0, 0.0] * 4), (12, [])]


def test_links_on_the_table(spark, sf_dir):
    rows = [(i, list(v) if v is not None else None) for i, v in cases.fetch(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")]
    want = plain_links(rows, 0.9)
    got = cases.fetch(op4_graph_dedup(spark, sf_dir), "vec_id", "n_links", "component_id", "kept")
    assert len(got) == len(rows) and all(k == (i == c) for i, _, c, k in got)
    assert all(n <= want[i][0] for i, n, _, _ in got)
    assert sum(n for _, n, _, _ in got) >= 0.95 * sum(n for n, _ in want.values())
    assert np.mean([c == want[i][1] for i, _, c, _ in got]) >= 0.95


def test_links_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(graph_dedup, "SHARD", 60)
    monkeypatch.setattr(graph_dedup, "BLOCK", 40)
    x = np.concatenate([clustered(500, 25), np.tile(clustered(1, 1, 9), (120, 1)) + 1e-3 * np.random.default_rng(2).normal(size=(120, 16))])
    rows = [(i + 1, v.tolist()) for i, v in enumerate(x)]
    want = plain_links(rows, 0.9)
    df = graph_dedup.near_vectors(vectors(spark, rows), "vec_id", "embedding", 0.9)
    got = cases.fetch(df, "vec_id", "n_links", "component_id", "audit_recall")
    assert all(n <= want[i][0] for i, n, _, _ in got)
    assert sum(n for _, n, _, _ in got) >= 0.95 * sum(n for n, _ in want.values())
    assert got[0][3] >= 0.9


def test_audit_has_evidence_without_links(spark, monkeypatch):
    monkeypatch.setattr(graph_dedup, "SHARD", 30)
    monkeypatch.setattr(graph_dedup, "HOMES", 1)
    monkeypatch.setattr(graph_dedup, "least_visits", lambda *a: 1)
    tried, linked = [], graph_dedup.linked
    monkeypatch.setattr(graph_dedup, "linked", lambda *a: tried.append(a[-1]) or linked(*a))
    x = np.random.default_rng(3).normal(size=(600, 16))
    rows = [(i + 1, v.tolist()) for i, v in enumerate(x)]
    assert not any(n for n, _ in plain_links(rows, 0.9).values())
    got = cases.fetch(graph_dedup.near_vectors(vectors(spark, rows), "vec_id", "embedding", 0.9), "n_links", "kept", "audit_recall")
    assert len(tried) > 1 and all(n == 0 and kept and r >= graph_dedup.TARGET for n, kept, r in got)


def test_recall_counts_vectors():
    few, big = {(False, i): 1 for i in range(40)}, {(False, 100 + i): 1000 for i in range(40)}
    assert graph_dedup.audited(few | big, big) == 0.5
    assert graph_dedup.audited({(True, i): 1 for i in range(10)}, {(True, i): 1 for i in range(5)}) == 0.5


def test_odd_vectors(spark):
    got = cases.fetch(graph_dedup.near_vectors(vectors(spark, [*ODD, (None, [1.0] * 8), (None, None)], extra=True), "vec_id", "embedding", 0.9), "vec_id", "n_links", "component_id", "kept")
    assert {i: (n, c) for i, n, c, _ in got if i is not None} == plain_links(ODD, 0.9)
    assert [(n, c, k) for i, n, c, k in got if i is None] == [(0, None, False)] * 2
    assert graph_dedup.near_vectors(vectors(spark, []), "vec_id", "embedding").count() == 0
    assert cases.fetch(graph_dedup.near_vectors(vectors(spark, ODD[:2]), "vec_id", "embedding"), "n_links", "kept") == [(0, True)] * 2


def plain_search(rows, every, top):
    own = [(i, np.array(v, float)) for i, v in rows if i is not None and takes_part(v)]
    cosine = lambda q, x: float((q * x).sum() / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum())))
    return {i: sorted(((-cosine(q, x), j) for j, x in own if j != i))[:top] for i, q in own if i % every == 0}


def recall(got, want, top):
    """Share of the true neighbours found, by score where several tie."""
    hits = total = 0
    for i, near in want.items():
        own = sorted((r, j, s) for q, r, j, s in got if q == i)
        assert [r for r, _, _ in own] == list(range(1, len(near) + 1))
        assert [(-s, j) for _, j, s in own] == sorted((-s, j) for _, j, s in own)
        hits += len({j for _, j, _ in own} & {j for _, j in near})
        total += len(near)
    return hits / total


def test_search_on_the_table(spark, sf_dir):
    rows = [(i, list(v) if v is not None else None) for i, v in cases.fetch(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")]
    got = cases.fetch(op6_ivfpq_search(spark, sf_dir), "query_id", "rank", "vec_id", "score")
    want = plain_search(rows, 50, 5)
    assert recall(got, want, 5) >= 0.9
    exact = {(i, j): -s for i, near in plain_search(rows, 50, len(rows)).items() for s, j in near}
    assert all(abs(s - exact[i, j]) < 1e-12 for i, _, j, s in got)


def test_search_over_many_lists(spark, monkeypatch):
    monkeypatch.setattr(ivfpq, "BLOCK", 50)
    x = np.concatenate([clustered(700, 30, 4, noise=0.3), np.tile(clustered(1, 1, 9), (150, 1))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = cases.fetch(ivfpq.neighbours(vectors(spark, rows), "vec_id", "embedding", 10), "query_id", "rank", "vec_id", "score")
    assert recall(got, plain_search(rows, 10, 5), 5) >= 0.9


def test_search_of_odd_vectors(spark):
    rows = [*ODD, (None, [1.0] * 8), (20, None)]
    got = cases.fetch(ivfpq.neighbours(vectors(spark, rows, extra=True), "vec_id", "embedding", 2), "query_id", "rank", "vec_id", "score")
    want = plain_search([r for r in rows if r[1] != []], 2, 5)
    assert {(q, r): j for q, r, j, _ in got} == {(i, r + 1): j for i, near in want.items() for r, (_, j) in enumerate(near)}
    assert ivfpq.neighbours(vectors(spark, []), "vec_id", "embedding", 2).count() == 0
    assert ivfpq.neighbours(vectors(spark, [(2, [1.0, 2.0])]), "vec_id", "embedding", 2).count() == 0


MIXED = [(1, [1.0, 0.0] * 4), (2, [1.0, 1.0, 0.0, 0.0, 2.0]), (3, [1.0, 1.0, 0.0, 0.0, 2.1]), (4, [1.0, 0.1] * 4), (6, [1.0, 1.0, 0.0, 0.0, -2.0]), (8, [1e-200, 1e-200, 1e-201]), (10, [2e-200, 2e-200, 2e-201]), (12, [1e200, 1e200, 1e199]), (14, [-1e200, 1e200, 1e199]), (16, [5.0]), (18, [7.0])]


def same_length(rows, ask):
    """The plain version for each length apart, on rows scaled to a largest component of 1."""
    out = {}
    for d in {len(v) for _, v in rows}:
        out |= ask([(i, (np.array(v) / max(map(abs, v))).tolist()) for i, v in rows if len(v) == d])
    return out


def test_lengths_and_magnitudes(spark):
    df = vectors(spark, MIXED)
    got = cases.fetch(graph_dedup.near_vectors(df, "vec_id", "embedding", 0.9), "vec_id", "n_links", "component_id", "audit_recall")
    assert {i: (n, c) for i, n, c, _ in got} == same_length(MIXED, lambda own: plain_links(own, 0.9)) and got[0][3] == 1
    got = cases.fetch(ivfpq.neighbours(df, "vec_id", "embedding", 2), "query_id", "rank", "vec_id")
    want = same_length(MIXED, lambda own: plain_search(own, 2, 5))
    assert {(q, r): j for q, r, j in got} == {(i, r + 1): j for i, near in want.items() for r, (_, j) in enumerate(near)}


def test_a_query_id_on_several_rows(spark):
    """Five distinct answers, none of them the query's own id."""
    x = clustered(60, 3, 5)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10, x[10].tolist()), (10, x[20].tolist()), (11, x[11].tolist())]
    got = cases.fetch(ivfpq.neighbours(vectors(spark, rows), "vec_id", "embedding", 10), "query_id", "rank", "vec_id", "score")
    exact = lambda i, j: max(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) for k, a in rows if k == i for m, b in rows if m == j)
    for q in range(0, 60, 10):
        own = sorted((r, j, s) for i, r, j, s in got if i == q)
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and len({j for _, j, _ in own} - {q}) == 5
        assert all(abs(s - exact(q, j)) < 1e-12 for _, j, s in own)
        assert own[0][2] >= max(exact(q, j) for j in range(60) if j != q) - 1e-12
