"""Measures of texts in one pass against patterns."""
import random
import re

import regex

from winnowry.functions import codepoints
from winnowry.functions import text as T

ALPHABET = "abAB01 .,!\n\t 　あア一丁가♪〜ーé🙂\x07|/"


def texts(n=400):
    rng = random.Random(5)
    out = ["", " ", "aaaaa", "ababab", "abcabcabc", "x" * 9, "\n\n\n\n\n\n", "一一一", "a a a a a a"]
    for _ in range(n):
        unit = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 9)))
        out.append("".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) + unit * rng.randint(0, 4) + "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 9))))
    return out


def test_measures_equal_patterns():
    kinds = tuple(T.KINDS.items())
    every = texts()
    got = codepoints.measure(every, kinds, range(2, 9))
    space, punctuation = re.compile(f"[{codepoints.WHITE}]"), regex.compile(T.PUNCTUATION)
    for k, text in enumerate(every):
        text = text.strip(codepoints.WHITE)
        plain, bare = space.sub("", text), re.sub(r"(.)\1{2,}", r"\1", punctuation.sub("", text), flags=re.S)
        assert got["length"][k] == len(text) and got["plain"][k] == len(plain) and got["content"][k] == len(bare)
        assert got["loop"][k] == bool(re.search(r"(.{2,8})\1\1", plain)), text
        assert got["run"][k] == bool(re.search(r"(.)\1{4}", text)), text
        assert got["top"][k] == (max(map(plain.count, set(plain)), default=0) * 2 > len(plain))
        for name in ("hangul", "kana", "cjk", "latin", "alnum", "digits", "control", "script_ja", "script_zh", "script_en"):
            assert got[name][k] == len(regex.findall(T.KINDS[name], text)), (name, text)


def test_chunks_give_the_same(monkeypatch):
    every, kinds = texts(60), tuple(T.KINDS.items())
    whole = codepoints.measure(every, kinds, range(2, 9))
    monkeypatch.setattr(codepoints, "CHUNK", 40)
    parts = [codepoints.measure(every[a:b], kinds, range(2, 9)) for a, b in codepoints._chunks(every)]
    for name in whole:
        assert [x for p in parts for x in p[name].tolist()] == whole[name].tolist()


def test_without_collapses_runs(spark):
    rows = spark.createDataFrame([(0, "a。。bbbb c!!!d"), (1, None), (2, "。。"), (3, "えええーーx")], "k int, t string")
    got = {r["k"]: r["c"] for r in rows.selectExpr("k", "t").withColumn("c", T.content_chars(rows["t"])).collect()}
    assert got == {0: "abcd", 1: "", 2: "", 3: "えx"}
