"""Phrases in texts and texts in phrases against comparing all with all."""
import random

import pytest
from pyspark.sql import functions as F

from winnowry.operators.substrings import PhraseIndex, anchor, substring_pairs, window_hashes

RNG = random.Random(11)
WORDS = ["ab", "abc", "b", "café", "日本", "日本語", "🤦", "a b", "xyzzy", "the quick brown fox jumps", "the quick brown fox", "quick brown"]
TEXTS = ["", None, "a", "ab", "日本語", "the quick", "fox", " ".join(WORDS)] + ["".join(RNG.choices("ab c日🤦", k=RNG.randrange(1, 60))) for _ in range(300)]
PHRASES = WORDS + ["", None] + ["".join(RNG.choices("ab c日🤦", k=RNG.randrange(1, 40))) for _ in range(200)]


def expected(both=True):
    phrases = {p for p in PHRASES if p}
    return sorted((k, p) for k, t in enumerate(TEXTS) if t for p in phrases if p in t or (both and t in p))


def tables(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "key long, text string").repartition(3), spark.createDataFrame([(p,) for p in PHRASES], "p string")


@pytest.mark.parametrize("both", [True, False])
@pytest.mark.parametrize("size", [1 << 22, 0])
def test_pairs(spark, both, size):
    texts, phrases = tables(spark)
    found = substring_pairs(texts, phrases, both, size)
    assert sorted(tuple(r) for r in found.collect()) == expected(both)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_repeated_rows_and_keys_of_any_kind(spark):
    texts = spark.createDataFrame([("k", "abc"), ("k", "abc"), (None, "b")], "key string, text string").withColumns({"p": F.lit(1), "row": F.lit(2)})
    for size in (1 << 22, 0):
        got = substring_pairs(texts, spark.createDataFrame([("b",), ("b",), ("abcd",)], "p string"), index_bytes=size).collect()
        assert sorted(map(tuple, got), key=repr) == sorted([("k", "b"), ("k", "b"), ("k", "abcd"), ("k", "abcd"), (None, "b"), (None, "abcd")], key=repr)


def test_anchor_is_the_window_where_a_string_stands():
    for p in WORDS:
        n, h = anchor(p)
        text = "x日" + p + "y"
        assert int(window_hashes(text)[n][2]) == h


def test_many_phrases():
    phrases = sorted({f"phrase {k:05d} of many" for k in range(20_000)} | {"ph", "p"})
    index = PhraseIndex(phrases)
    texts = ["... phrase 00017 of many, phrase 19999 of many", "p" * 5000, "none"]
    assert sorted((r, phrases[v]) for r, v in index.within(texts)) == [(0, "p"), (0, "ph"), (0, "phrase 00017 of many"), (0, "phrase 19999 of many"), (1, "p")]
    assert len(index.around("of man")) == 20_000


def test_join_writes_only_windows_that_may_be_anchors(spark):
    # 2000 texts of 400 different windows of each length or so; each holds two of the phrases
    rng = random.Random(3)
    texts = spark.createDataFrame([(k, "".join(rng.choices("abcdefghij ", k=400)) + f" phrase {k % 50:03d} of many") for k in range(2000)], "key long, text string").repartition(4)
    phrases = spark.createDataFrame([(f"phrase {k:03d} of",) for k in range(50)] + [("of many",)], "p string")

    def written():
        sc = spark.sparkContext
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = written()
    assert substring_pairs(texts, phrases, index_bytes=0).count() == 4000
    assert written() - before < 40_000
