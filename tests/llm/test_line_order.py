"""Orders of a block's words within its lines, and the lines that words belong to, against plain sorting."""
import numpy as np
import pytest

from winnowry.llm import line_dedup
from winnowry.llm._arrow import U64

RNG = np.random.default_rng(5)


@pytest.mark.parametrize("n,lines,bits", [(1, 1, 64), (2, 1, 64), (5000, 300, 64), (5000, 300, 20), (60_000, 1 << 19, 64), (70_000, 1 << 20, 64), (3000, 3, 64)])
def test_order(n, lines, bits):
    line = np.sort(RNG.integers(0, lines, n))
    words = RNG.integers(0, 1 << 63, n, dtype=np.uint64) & U64((1 << bits) - 1)  # few bits leave different words in ties
    words[::7] = words[0]
    ranks = RNG.permutation(line_dedup.COUNTERS)
    exact = lambda *keys: np.lexsort(keys)
    found = line_dedup.order_of(line, words >> U64(20), words, lambda: exact(words, line))
    wanted = exact(words, line)
    assert (words[found] == words[wanted]).all() and (line[found] == line[wanted]).all() and len(set(found.tolist())) == n
    found, wanted = line_dedup.by_rarity(words, line, ranks), exact(words, ranks[line_dedup.bucket_of(words)], line)
    assert (words[found] == words[wanted]).all() and (line[found] == line[wanted]).all()


def test_numbers_are_sorted_themselves(monkeypatch):
    def argsort(*a, **k):
        raise AssertionError("sorts places by numbers")

    line, words = np.arange(40_000) // 20, RNG.integers(0, 1 << 63, 40_000, dtype=np.uint64)
    monkeypatch.setattr(np, "argsort", argsort)
    order = line_dedup.order_of(line, words >> U64(20), words, None)
    assert (order // 20 == line).all() and (np.diff(words[order].reshape(-1, 20).astype(np.float64)) >= 0).all()


def test_words_belong_to_the_last_line_that_begins_before_them():
    texts = ["", "\n\n", "a b\n\nc", "\n x\n", "", "y", " \n"]
    data, at = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    doc, number, words, of, line = line_dedup.line_sets(data, at)
    wanted = [(d, k, len(set(x.split()))) for d, t in enumerate(texts) for k, x in enumerate(t.split("\n"))]
    assert list(zip(doc.tolist(), number.tolist(), np.diff(of).tolist(), strict=True)) == wanted
