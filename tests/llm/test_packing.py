import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessaline.llm import packing
from tessaline.llm.common import table
from tessaline.llm.queries import op1_best_fit_packing, vocabulary
from tests.llm import cases


def best_fit_decreasing(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= s]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(capacity - s)
    return len(rooms)


def least_bins(sizes, capacity):
    """Exact by branch and bound; small instances only."""
    sizes, best = sorted(sizes, reverse=True), [best_fit_decreasing(sizes, capacity)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= sizes[i]:
                k = rooms.index(r)
                place(i + 1, rooms[:k] + [r - sizes[i]] + rooms[k + 1 :])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best[0]


@given(st.lists(st.integers(1, 20), max_size=9))
@settings(max_examples=150, deadline=None)
def test_fixed_sets_are_part_of_some_optimum(sizes):
    count = [0] * 21
    for s in sizes:
        count[s] += 1
    fixed = packing.reduce_instance(count, 20)
    rest = [s for s, n in enumerate(count) for _ in range(n)]
    assert sum(fixed.values()) + least_bins(rest, 20) == least_bins(sizes, 20)


@given(st.lists(st.integers(1, 100), max_size=300))
@settings(max_examples=100, deadline=None)
def test_group_best_fit_equals_item_by_item(sizes):
    count = [0] * 101
    for s in sizes:
        count[s] += 1
    assert sum(packing.best_fit(count, 100).values()) == best_fit_decreasing(sizes, 100)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50)))
@settings(max_examples=100, deadline=None)
def test_solution_holds_every_item_once(sizes):
    patterns = packing.solve(dict(sizes), 64)
    held = Counter()
    for pattern, bins in patterns.items():
        assert sum(s * n for s, n in pattern) <= 64
        for s, n in pattern:
            held[s] += n * bins
    assert held == Counter(sizes)
    places = packing.Places(patterns)
    used = defaultdict(list)
    for s, n in sizes.items():
        seq, off = places.find(np.full(n, s), np.arange(n))
        for q, o in zip(seq.tolist(), off.tolist()):
            used[q].append((o, s))
    for spans in used.values():
        at = 0
        for o, s in sorted(spans):
            assert o == at
            at += s
        assert at <= 64


def test_size_outside_the_capacity():
    with pytest.raises(ValueError):
        packing.solve({65: 1}, 64)


def hold(rows, texts, capacity=1024):
    """The contract, against the tokenizers library."""
    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for doc, piece, start, length, crc, seq, offset in rows:
        by_doc[doc].append((piece, start, length, crc))
        sequences[seq].append((offset, length))
    assert by_doc.keys() == texts.keys()
    for doc, text in texts.items():
        ids = np.array(lib.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(by_doc[doc])):
            assert (piece, start) == (k, at) and 1 <= length <= capacity
            assert k == 0 or length == capacity
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
        assert len(by_doc[doc]) == -(-len(ids) // capacity)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    rows = cases.fetch(op1_best_fit_packing(spark, sf_dir), "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    bins = hold(rows, texts)
    sizes = [r[3] for r in rows]
    assert -(-sum(sizes) // 1024) <= bins <= best_fit_decreasing(sizes, 1024)


def test_odd_rows(spark):
    df = cases.docs(spark, repeat=False, extra=True)
    got = packing.pack(df, vocabulary("byte_bpe_50k.json"))
    hold(cases.fetch(got, "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"), {i + 1: t for i, t in enumerate(cases.TEXTS)})
    repeated = packing.pack(cases.docs(spark), vocabulary("byte_bpe_50k.json"))
    assert repeated.where("doc_id = 4").count() == 2 and repeated.where("doc_id IS NULL").count() == 2
    assert packing.pack(cases.empty(spark), vocabulary("byte_bpe_50k.json")).count() == 0
