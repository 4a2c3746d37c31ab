"""Marked words of the sets of a batch are found together, as one set at a time would give them."""
import numpy as np
import pyarrow as pa

from winnowry.llm import line_dedup as m


def test_marked_words_of_many_sets():
    rng = np.random.default_rng(4)
    n = rng.integers(6, 40, 300)
    of = np.concatenate([[0], np.cumsum(n)])
    words = rng.integers(0, 1 << 63, of[-1]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    words[rng.integers(0, of[-1], 200)] = words[5]
    marks = [[{"word": int(w), "many": int(rng.integers(1, 4))} for w in np.unique(rng.choice(words[of[i] : of[i + 1]].view(np.int64), rng.integers(0, 6)))] + [{"word": 17, "many": 2}] * (i % 7 == 0) for i in range(300)]
    column = pa.array(marks, pa.list_(pa.struct([("word", pa.int64()), ("many", pa.int32())])))
    for low, high in ((0, 300), (100, 200), (50, 50)):
        want = []
        for i in range(low, high):
            many = {x["word"]: x["many"] for x in marks[i]}
            head = words[of[i] : of[i + 1]][: m.prefix_length(n[i])].view(np.int64).tolist()
            want += [(i - low, k, many[w]) for k, w in enumerate(head) if w in many]
        got = m.marked(words[of[low] : of[high]], of[low : high + 1] - of[low], column.slice(low, high - low))
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want
