"""Recall of the vector index against brute force where the grid has some dozens of codewords, and vectors of other lengths and precision."""
import numpy as np

from winnowry.llm import embedding_dedup as m

DIM = 64


def planted(rng, base, cosine, where):
    """Vectors at the given cosines to the bases, with the rest of their length along noise in some components only."""
    noise = np.zeros_like(base)
    noise[:, where] = rng.normal(size=(len(base), len(range(*where.indices(DIM)))))
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return cosine[:, None] * base + np.sqrt(1 - cosine**2)[:, None] * noise


def test_recall_on_a_grid_of_dozens_of_cells(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(10_000, DIM))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    copies = [planted(rng, base[k : k + 500], rng.uniform(0.9001, 0.92, 500), where) for k, where in ((0, slice(None)), (500, slice(0, DIM // 2)), (1000, slice(DIM // 2, DIM)))]
    vectors = np.concatenate([base, *copies])
    grid = m.fit(vectors[: m.SAMPLE], len(vectors))
    assert grid.size >= 8 and grid.probes < grid.size**2
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(8)
    got = {r["vec_id"]: r for r in m.near_duplicate_vectors(rows).collect()}
    links = vectors @ vectors.T / (np.linalg.norm(vectors, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)) >= 0.9
    np.fill_diagonal(links, False)
    want = links.sum(1)
    found = np.array([got[k]["n_links"] for k in range(len(vectors))])
    print(f"codewords {grid.size}, probes {grid.probes}, links {want.sum() // 2}, recall {found.sum() / want.sum():.4f}")
    assert (found <= want).all() and want.sum() >= 3000
    for part in (slice(10_000, 10_500), slice(10_500, 11_000), slice(11_000, 11_500)):
        assert found[part].sum() / want[part].sum() >= 0.95
    assert all(got[k]["component_id"] in (k, *np.flatnonzero(links[k])) for k in range(10_000, 11_500) if want[k] == 1)


def test_each_length_and_double_precision(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=8)
    b = rng.normal(size=8)
    b -= (a @ b) / (a @ a) * a
    b *= np.linalg.norm(a) / np.linalg.norm(b)
    near = lambda c: c * a + np.sqrt(1 - c * c) * b
    vectors = [a, near(0.9 + 1e-9), near(0.9 - 1e-9), a[:4], 2 * a[:4], a[:4] * 1e300, a * 1e-200, [1.0], [2.0], [-1.0], [], None, [0.0, 0.0], [float("inf"), 1.0], [1.0, None], rng.normal(size=5)]
    rows = spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v]) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in m.near_duplicate_vectors(rows).collect()}
    assert got[0] == (2, 0, True) and got[1][1:] == (0, False) and got[6] == (2, 0, False)
    assert got[2][1] in (1, 2) or got[2][0] >= 1  # linked with the vector on its own side only
    assert (got[2][0], got[1][0]) == (1, 3)
    assert [got[k] for k in (3, 4, 5)] == [(2, 3, True), (2, 3, False), (2, 3, False)]
    assert [got[k] for k in (7, 8, 9)] == [(1, 7, True), (1, 7, False), (0, 9, True)]
    assert all(got[k] == (0, k, True) for k in range(10, 16))
