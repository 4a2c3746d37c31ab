"""Hashes of words from eight bytes at a time."""
import numpy as np

from winnowry.llm._arrow import word_hashes


def test_hashes_of_words_of_any_length():
    rng = np.random.default_rng(8)
    words = [rng.integers(97, 123, int(k), dtype=np.uint8).tobytes() for k in [*range(1, 80), 5000, 100_000]] + [b"\0" * k for k in range(1, 40)] + [b"abcdefgh" * k for k in (2, 3)] + ["é".encode() * 9]
    flat, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    ends = np.cumsum(size)
    got = word_hashes(flat, ends - size, ends)
    assert len(set(got.tolist())) == len(words) and not len(word_hashes(flat[:0], ends[:0], ends[:0]))
    order = rng.permutation(len(words))
    moved = b"".join(b" " + (words[i].upper() if i % 2 else words[i]) for i in order)
    ends = np.cumsum(size[order] + 1)
    assert (word_hashes(np.frombuffer(moved, np.uint8), ends - size[order], ends) == got[order]).all()
