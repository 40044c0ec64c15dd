from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessaline.llm import common
from tessaline.llm.common import Memo, spread_join
from tests.llm import cases


@pytest.mark.parametrize("hot", [2, 4096])
def test_spread_join_is_a_left_join(spark, monkeypatch, hot):
    """With a hot key, keys that facts lack, and null keys; whichever keys count as hot."""
    monkeypatch.setattr(common, "HOT", hot)
    rows = [(i, 7 if i % 3 else i, 1) for i in range(300)] + [(1000, None, 1), (1001, 5000, 1)]
    left = spark.createDataFrame(rows, "id long, a long, b long")
    facts = left.where("a < 5000").groupBy("a", "b").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    got = cases.fetch(spread_join(left, facts, ["a", "b"], "n"), "id", "a", "last", "n")
    want = cases.fetch(left.join(facts, ["a", "b"], "left"), "id", "a", "last", "n")
    assert Counter(got) == Counter(want) and len(got) == len(rows)
    assert cases.fetch(spread_join(left, facts.where("false"), ["a", "b"], "n"), "last") == [(None,)] * len(rows)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(common, "MEMO_CHARS", 100)
    asked = []

    def make(words):
        asked.extend(words)
        return map(len, words)

    memo = Memo(20)
    for i in range(50):
        words = {"often", f"once{i}", "x" * 500}
        assert memo.of(words, make) == {w: len(w) for w in words}
    assert asked.count("often") <= 10 and asked.count("x" * 500) == 50
    assert sum(map(len, memo.now)) <= 120 and not any(len(w) > common.LONG_WORD for w in {*memo.now, *memo.old})


def test_a_folder_is_needed_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        common.ensure_checkpoint_dir(Session())
