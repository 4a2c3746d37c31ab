"""Words of lines in the order of rarity."""
import numpy as np

from winnowry.llm import line_dedup


def test_words_come_by_rarity_from_one_sort():
    data = b"b a c b a\nd d a e\n\nz y x w v u t z"
    at = np.array([0, 16, len(data)])
    ranks = np.random.default_rng(3).permutation(line_dedup.COUNTERS)
    doc, number, words, of, line = line_dedup.line_sets(data := np.frombuffer(data, np.uint8), at)
    got = line_dedup.line_sets(data, at, ranks)
    assert all((a == b).all() for a, b in zip((doc, number, of, line), (*got[:2], *got[3:]), strict=True))
    assert (got[2] == words[np.lexsort((words, ranks[line_dedup.bucket_of(words)], line))]).all()
    assert (line_dedup.keys_of(words, of) == line_dedup.keys_of(got[2], of)).all()
