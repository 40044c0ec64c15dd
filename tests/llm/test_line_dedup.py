import hashlib
from collections import defaultdict

import pytest

from tessaline.llm.common import table
from tessaline.llm.line_dedup import dedup_lines
from tessaline.llm.queries import op10_line_dedup
from tests.llm import cases

BLANKS = " \t\n\x0b\x0c\r"


def plain(rows, min_docs=2):
    """rows: (doc_id, text); in order, (doc_id, n_lines, n_dropped, kept)."""
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10 and doc is not None:
                held[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(held.get(key(x), ())) < min_docs or min(held[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    want = [(d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in plain(rows)]
    assert sum(w[2] for w in want) > 0
    assert order(cases.fetch(op10_line_dedup(spark, sf_dir), "doc_id", "n_lines", "n_dropped", "kept_sha256")) == order(want)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_odd_rows(spark, min_docs):
    texts = [*cases.TEXTS, "x\n\tA Line Here Twice\r\nx", "a line here twice\na line here twice", "É line here twice\né LINE here twice", "É LINE HERE TWICE", "\n" * 50, "A Shared Line Of Text Here"]
    df = cases.docs(spark, texts, extra=True)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = [(d, n, g, t or "") for d, n, g, t in cases.fetch(dedup_lines(df, min_docs=min_docs), "doc_id", "n_lines", "n_dropped", "text")]
    assert order(got) == order(plain(rows, min_docs))
    assert set(df.columns) | {"n_dropped"} == set(dedup_lines(df).columns)


def test_empty_table(spark):
    assert dedup_lines(cases.empty(spark)).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = op10_line_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_documents_of_many_shared_lines(spark):
    """Reassembly is by place: thousands of lost lines in one document."""
    shared = [f"shared line number {i}" for i in range(6000)]
    df = cases.docs(spark, ["\n".join(shared), "\n".join(["own line at the start", *shared, "own line at the end"])], repeat=False)
    got = {r["doc_id"]: (r["n_dropped"], r["text"]) for r in dedup_lines(df).collect()}
    assert got[1] == (0, "\n".join(shared)) and got[2] == (6000, "own line at the start\nown line at the end")
