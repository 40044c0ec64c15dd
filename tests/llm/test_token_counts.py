import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessaline.llm.byte_bpe import byte_bpe
from tessaline.llm.common import table
from tessaline.llm.queries import op2_token_counts, vocabulary
from tessaline.llm.token_counts import count_tokens, counter
from tests.llm import cases

PATH = vocabulary("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
ODD = st.lists(st.sampled_from([*" \t\n\r'sStmdrelv1²½aé!?  ́日🎉_-<|>endoftx’", "'ll", "'re", "'ve", "<|endoftext|>", "  "]), max_size=60).map("".join)


def true_count(text):
    return len(LIB.encode(text or "", add_special_tokens=False).ids)


@given(st.lists(st.one_of(ODD, st.text(max_size=40)), max_size=8))
@settings(max_examples=400, deadline=None)
def test_counts_equal_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert counter(PATH).count(texts) == [true_count(t) for t in texts]


@given(ODD)
@settings(max_examples=200, deadline=None)
def test_ids_equal_the_library(text):
    assert byte_bpe(PATH).encode(text).tolist() == LIB.encode(text, add_special_tokens=False).ids


def test_texts_longer_than_many_chunks():
    texts = [cases.LONG, " " * 5000 + "x", "'" * 999, "a" * 3000 + " 'll" * 500]
    assert counter(PATH).count(texts) == [true_count(t) for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_another_file_goes_to_the_library(name):
    lib = Tokenizer.from_file(vocabulary(name))
    assert counter(vocabulary(name)).count(["Hello  World it's", ""]) == [len(lib.encode(t, add_special_tokens=False).ids) for t in ("Hello  World it's", "")]


def check(df, texts):
    for doc, size, n, over in cases.fetch(df, "doc_id", "n_bytes", "n_tokens", "over_limit"):
        text = texts[doc]
        assert (size, n, over) == (len((text or "").encode()), true_count(text), true_count(text) > 512)


def test_query(spark, sf_dir):
    check(op2_token_counts(spark, sf_dir), {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()})


def test_odd_rows(spark):
    check(count_tokens(cases.docs(spark, extra=True, repeat=False), PATH), {i + 1: t for i, t in enumerate(cases.TEXTS)})
    got = count_tokens(cases.docs(spark), PATH)
    assert got.count() == len(cases.TEXTS) + 3 and got.where("doc_id IS NULL").count() == 2
    assert count_tokens(cases.empty(spark), PATH).count() == 0
