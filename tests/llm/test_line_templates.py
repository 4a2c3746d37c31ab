"""Line dedup where very many lines share their rarest words, and where a text has very many lines."""
import time

import numpy as np

from winnowry.llm import line_dedup as m


def lines_of_a_template(rng, many):
    out = []
    for k in range(many):
        words = [f"t{j}" for j in range(22)]
        for at in rng.choice(22, int(rng.integers(0, 4)), replace=False):
            words[at] = f"v{rng.integers(60)}"
        out.append(" ".join(dict.fromkeys(words)))
    return out


def test_lines_of_one_template_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 700)  # so that the hot words are dealt into blocks
    lines = lines_of_a_template(np.random.default_rng(2), 5000)
    rows = spark.createDataFrame([(k, "\n".join(lines[k * 50 : k * 50 + 50])) for k in range(100)], "doc_id long, text string").repartition(4)
    kinds = sorted({w for x in lines for w in x.split()})
    at = {w: k for k, w in enumerate(kinds)}
    sets = np.zeros((len(lines), len(kinds)), np.float32)
    for k, x in enumerate(lines):
        sets[k, [at[w] for w in x.split()]] = 1
    first = {}
    for k in range(len(lines)):
        first.setdefault(sets[k].tobytes(), k)
    one = np.array(sorted(first.values()))
    both = sets[one] @ sets[one].T
    n = sets[one].sum(1)
    linked = (100 * both >= 85 * (n[:, None] + n - both)) & ~np.eye(len(one), dtype=bool)
    links = dict(zip(one.tolist(), linked.sum(1).tolist(), strict=True))
    late = {k: bool(linked[i, :i].any()) for i, k in enumerate(one.tolist())}
    got = m.duplicate_lines(rows).collect()
    assert len(got) == len(lines)
    for r in got:
        k = r["doc_id"] * 50 + r["line"]
        c = first[sets[k].tobytes()]
        assert (r["class_id"] * 50 + r["class_line"], r["n_links"], r["removed"]) == (c, links[c], k != c or late[c])


def test_a_text_of_very_many_lines_is_done_in_seconds(spark):
    text = "\n".join(f"line {k % 60_000} says a thing or two" for k in range(100_000))
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    found = m.duplicate_lines(rows).where("removed").select("line").collect()
    kept = m.drop_lines(rows).first()["text"].split("\n")
    gone = {r["line"] for r in found}
    assert kept == [x for k, x in enumerate(text.split("\n")) if k not in gone] and len(kept) < 60_001
    assert time.time() - began < 120


def test_long_lines_meet_in_bounded_matrices(monkeypatch):
    """Sides by lists and by words, and several ranges of columns, against sets."""
    rng = np.random.default_rng(12)
    monkeypatch.setattr(m, "SIDE_WORDS", 900)
    monkeypatch.setattr(m, "COLUMNS", 64)
    base = rng.permutation(5000)[:300].astype(np.uint64)
    lists = [np.unique(np.concatenate([rng.choice(base, k, replace=False), rng.integers(5000, 6000, 8).astype(np.uint64)])) for k in rng.integers(20, 290, 60)] + [base[:200], base[:210], base[:205]]
    lists = [rng.permutation(x) for x in lists]
    at = rng.integers(0, 3, len(lists))
    got = {(int(i[r]), int(j[c])) for i, j, close in m.linked_within(lists, at) for r, c in zip(*np.nonzero(close), strict=True)}
    want = set()
    for i in range(len(lists)):
        for j in range(i):
            both = len(set(lists[i].tolist()) & set(lists[j].tolist()))
            apart = not set(lists[i][: at[i]].tolist()) & set(lists[j][: at[j]].tolist())
            if apart and m.OF * both >= m.SIMILAR * (len(lists[i]) + len(lists[j]) - both):
                want.add((i, j))
    assert got == want and len(want) >= 3
