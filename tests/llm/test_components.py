"""Components take few written steps and tasks, whatever the number of shuffle partitions."""
import numpy as np

from winnowry.llm import _components as c


def smallest(u, v):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def test_trees_keep_what_is_linked():
    rng = np.random.default_rng(1)
    for n, links in ((10, 5), (1000, 800), (1000, 3000)):
        u, v = rng.integers(0, n, (2, links))
        up, to = c.trees(u, v)
        assert dict(zip(up.tolist(), to.tolist(), strict=True)) == {x: r for x, r in smallest(u, v).items() if x != r}


def test_few_steps_and_tasks(spark, monkeypatch):
    written = []

    def materialise(df, name):
        written.append(df.rdd.getNumPartitions() if name == "least" else 0)
        return kept(df, name)

    kept = c.materialise
    monkeypatch.setattr(c, "materialise", materialise)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rng = np.random.default_rng(2)
    names = rng.permutation(5000)  # a path in any order, a vertex with many links, and pairs
    u, v = np.concatenate([names[:1999], np.full(1500, names[2000]), names[4000:4500]]), np.concatenate([names[1:2000], names[2001:3501], names[4500:]])
    links = spark.createDataFrame(list(zip(u.tolist(), v.tolist(), strict=True)), "u long, v long").repartition(32)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        monkeypatch.setattr(c, "RUN", 50)
        got = {r["id"]: r["component"] for r in c.components(links).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == smallest(u, v)
    assert len(written) <= 13 and max(written) <= c.LEAST_TASKS
