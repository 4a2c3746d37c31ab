"""Near-dedup of large groups, repeated ids and rows without id against brute force."""
import numpy as np
from pyspark.sql import functions as F

from winnowry.llm import minhash_dedup as m


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute_force(sets):
    """Component (position of its first member) of each set, by counts of common shingles."""
    number: dict = {}
    rows = np.zeros((len(sets), 40_000), np.float32)
    for i, s in enumerate(sets):
        for x in s:
            rows[i, number.setdefault(x, len(number))] = 1
    rows = rows[:, : len(number)]
    both, n = rows @ rows.T, rows.sum(1)
    linked = (100 * both >= 75 * (n[:, None] + n - both)) & (both > 0)
    label = np.arange(len(sets))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(sets)).min(1))
        if (least == label).all():
            return label, linked
        label = least


def copies(rng, base, many, most):
    out = []
    for _ in range(many):
        words = list(base)
        at = int(rng.integers(len(words)))
        for k in range(at, at + int(rng.integers(0, most))):
            words[k % len(words)] = f"r{rng.integers(40)}"
        out.append(" ".join(words))
    return out


def test_a_large_group_whose_members_mostly_miss_the_smallest(spark):
    rng = np.random.default_rng(3)
    texts = copies(rng, [f"b{k}" for k in range(70)], 2000, 34) + copies(rng, [f"c{k}" for k in range(40)], 30, 12)
    label, linked = brute_force([shingles(t) for t in texts])
    assert len(set(label.tolist())) > 100 and linked[0].mean() < 0.4
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in m.near_duplicates(rows).collect()}
    assert [got[k] for k in range(len(texts))] == label.tolist()


def test_sets_of_a_family_join_only_what_is_linked():
    rng = np.random.default_rng(5)
    base = np.sort(rng.choice(1 << 40, 120, replace=False).astype(np.uint64))
    sets = [np.sort(rng.choice(base, int(rng.integers(90, 120)), replace=False)) for _ in range(60)]
    v, c, block = np.arange(60), np.arange(60), np.zeros(60, np.int64)
    want = {(a, b) for a in range(60) for b in range(a) if 100 * len(s := np.intersect1d(sets[a], sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - len(s))}
    links = m.joining(v, c, block, sets, -1)
    assert set(links) <= want

    def parts(pairs):
        label = list(range(60))
        for _ in range(60):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert parts(links) == parts(want) and len(links) == 60 - len(set(parts(want)))


def test_repeated_ids_and_rows_without_id(spark):
    rng = np.random.default_rng(6)
    texts = [*copies(rng, [f"d{k}" for k in range(60)], 12, 6), *copies(rng, [f"e{k}" for k in range(60)], 12, 6), *[" ".join(f"g{j}x{k}" for k in range(9)) for j in range(4)]]
    ids = [5, 5, 6, None, 7, 5, 6, 6, 9, 2, 1, 3, 5, None, None, 8, 8, 8, 4, 10, 11, 12, 13, 14, 5, None, None, 20]
    rows = [*zip(ids, texts, strict=True), (5, texts[0]), (None, texts[-2]), (30, ""), (30, ""), (None, None)]
    label, _ = brute_force([shingles(t or "") for _, t in rows])
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "id": F.lit("x"), "label": F.lit(2.5)})
    least = {k: min((rows[i][0] for i in range(len(rows)) if label[i] == k and rows[i][0] is not None), default=None) for k in set(label.tolist())}
    full = [bool(shingles(t or "")) for _, t in rows]
    want = sorted((str(rows[i][0]), str(least[label[i]] if full[i] else rows[i][0])) for i in range(len(rows)))
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in m.near_duplicates(table).collect())
    assert got == want
    kept = m.drop_near_duplicates(table)
    assert kept.columns == table.columns
    kept = kept.collect()
    of = {(i, t): k for (i, t), k in zip(rows, label.tolist(), strict=True)}
    assert sorted(of[r["doc_id"], r["text"]] for r in kept if r["text"]) == sorted({k for k, f in zip(label.tolist(), full, strict=True) if f})
    assert all(r["doc_id"] == least[of[r["doc_id"], r["text"]]] for r in kept if r["text"])
    assert sum(not r["text"] for r in kept) == 3
