"""Longest match from left to right against a plain loop."""
import random

import pytest

from winnowry.functions import conversion
from winnowry.operators.substrings import PhraseIndex


def by_hand(text, table):
    out, at = [], 0
    while at < len(text):
        n = max((len(p) for p in table if text.startswith(p, at)), default=0)
        out.append(table[text[at : at + n]] if n else text[at])
        at += n or 1
    return "".join(out)


TABLE = {"後": "后", "皇后": "皇后", "後面": "后面", "裡": "里", "a": "1", "ab": "2", "abc": "", "bcd": "4", "cc": "cccc", "🤦": "x", "日本語の長い句です": "long"}


def test_convert():
    rng = random.Random(4)
    texts = ["", "abcd", "abbcd", "皇后後面裡", "ccc", "日本語の長い句です日本語の長い句", "🤦🤦a"] + ["".join(rng.choices("abcd後面皇🤦", k=rng.randrange(50))) for _ in range(300)]
    index = PhraseIndex(sorted(TABLE))
    assert conversion.convert(texts, index, [TABLE[p] for p in index.phrases]) == [by_hand(t, TABLE) for t in texts]


def test_column(spark, monkeypatch):
    monkeypatch.setattr(conversion, "BLOCK_CHARS", 3)
    table = spark.createDataFrame([*TABLE.items(), ("a", "9"), ("", "x"), (None, "y"), ("z", None)], "phrase string, replacement string")
    change = conversion.longest_match(table)
    rows = spark.createDataFrame([(0, "abcd"), (1, None), (2, ""), (3, "後面"), (4, "z")], "k int, t string").coalesce(1)
    assert [r["x"] for r in rows.select("k", change("t").alias("x")).orderBy("k").collect()] == ["d", None, "", "后面", "z"]
    assert [r["x"] for r in rows.select("k", conversion.longest_match(table.limit(0))("t").alias("x")).orderBy("k").collect()] == ["abcd", None, "", "後面", "z"]
    monkeypatch.setattr(conversion, "MAX_TABLE_BYTES", 5)
    with pytest.raises(ValueError, match="more than 5"):
        conversion.longest_match(table)
