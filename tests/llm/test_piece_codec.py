import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessaline.llm.common import Memo, table
from tessaline.llm.piece_codec import codec, encode_pieces, piece_digests
from tessaline.llm.queries import op5_piece_codec, vocabulary
from tests.llm import cases

PATH = vocabulary("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)


def digests(text):
    ids = LIB.encode(text or "") + [LIB.eos_id()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(LIB.decode(ids))


@given(st.lists(st.one_of(st.text(max_size=60), st.text(st.sampled_from(list("ab the▁▁ \n\té日<s>")), max_size=60)), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_agenda_equals_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [ids for ids, _ in codec(PATH).encode(texts)] == LIB.encode(texts)


@given(st.text(st.sampled_from(list("abtheing▁é日🎉")), min_size=1, max_size=120))
@settings(max_examples=100, deadline=None)
def test_lock_step_equals_the_heap(word):
    import numpy as np

    assert np.frombuffer(codec(PATH).agendas([word])[0], "<i4").tolist() == codec(PATH).agenda(word)


def test_a_difference_stops_the_job(monkeypatch):
    c = codec(PATH)
    monkeypatch.setattr(c, "agendas", lambda words: [b"\1\0\0\0"] * len(words))
    monkeypatch.setattr(c, "words", Memo(10))
    with pytest.raises(ValueError):
        c.encode(["never met before zqj"])


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    rows = cases.fetch(op5_piece_codec(spark, sf_dir), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert len(rows) == len(texts)
    for doc, *got in rows:
        assert tuple(got) == digests(texts[doc])


def test_odd_rows(spark):
    rows = cases.fetch(piece_digests(cases.docs(spark, extra=True), PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert len(rows) == len(cases.TEXTS) + 3
    for doc, *got in rows:
        if doc is not None:
            assert tuple(got) == digests(cases.TEXTS[doc - 1])
    assert piece_digests(cases.empty(spark), PATH).count() == 0
    ids = encode_pieces(cases.docs(spark, ["hello world", None]), PATH).where("doc_id = 1").first()
    assert ids["ids"] == LIB.encode("hello world") + [2] and ids["decoded"] == "hello world"
