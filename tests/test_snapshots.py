"""Versions appear whole, merges touch few buckets, a killed or late writer changes nothing."""
import pytest

from winnowry.sources.snapshots import Conflict, Snapshots

SCHEMA = "id long, name string, x double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/store", 8)
    s.begin().replace("a", spark.createDataFrame([(k, f"n{k}", k / 2) for k in range(40)], SCHEMA), "id").replace("log", spark.createDataFrame([(0, "made")], "id long, what string"), "id").publish()
    return s


def test_merge_touches_its_buckets_only(spark, store):
    before = store.manifest()["tables"]["a"]["buckets"]
    changes = spark.createDataFrame([(3, "changed", None, False), (4, "gone", 0.0, True), (100, "new", 1.0, None)], SCHEMA + ", out boolean")
    assert store.begin().merge("a", changes, "out").publish() == 2
    want = {k: (k, f"n{k}", k / 2) for k in range(40) if k != 4} | {3: (3, "changed", None), 100: (100, "new", 1.0)}
    assert rows(store.read("a")) == sorted(want.values(), key=repr)
    after = store.manifest()["tables"]["a"]["buckets"]
    assert 1 <= sum(before.get(b) != after.get(b) for b in before.keys() | after.keys()) <= 3
    assert rows(store.read("a", 1)) == sorted(((k, f"n{k}", k / 2) for k in range(40)), key=repr)


def test_several_tables_are_one_commit(spark, store):
    seen = store.read("a")
    change = store.begin().merge("a", spark.createDataFrame([(1, "b", 9.0)], SCHEMA)).merge("log", spark.createDataFrame([(1, "merged")], "id long, what string"))
    assert store.versions() == [1] and rows(store.read("log")) == [(0, "made")]  # written, not published
    change.publish()
    assert rows(store.read("log")) == [(0, "made"), (1, "merged")]
    assert (1, "n1", 0.5) in rows(seen)  # a reader keeps the version that it began with


def test_a_killed_writer_leaves_the_old_version(spark, store):
    change = store.begin()
    change.merge("a", spark.createDataFrame([(1, "lost", 9.0)], SCHEMA))
    del change  # its files are there, its manifest isn't
    (1, "n1", 0.5) in rows(store.read("a"))
    assert store.vacuum() > 0 and (1, "n1", 0.5) in rows(store.read("a"))


def test_the_later_of_two_writers_is_refused(spark, store):
    one, two = store.begin(), store.begin()
    two.merge("a", spark.createDataFrame([(2, "two", 0.0)], SCHEMA)).publish()
    with pytest.raises(Conflict):
        one.merge("a", spark.createDataFrame([(1, "one", 0.0)], SCHEMA)).publish()
    assert (2, "two", 0.0) in rows(store.read("a")) and (1, "n1", 0.5) in rows(store.read("a"))


def test_rollback_and_vacuum(spark, store):
    store.begin().merge("a", spark.createDataFrame([(1, "b", 9.0)], SCHEMA)).publish()
    assert store.rollback(1) == 3
    assert (1, "n1", 0.5) in rows(store.read("a"))
    assert store.vacuum(keep=1) > 0 and store.versions() == [3] and len(rows(store.read("a"))) == 40
    with pytest.raises(ValueError):
        store.read("a", 1)


def test_awkward_changes(spark, store):
    with pytest.raises(ValueError, match="unique"):
        store.begin().merge("a", spark.createDataFrame([(1, "x", 0.0), (1, "y", 0.0)], SCHEMA))
    store.begin().merge("a", spark.createDataFrame([], SCHEMA)).publish()
    assert len(rows(store.read("a"))) == 40
    store.begin().replace("a", spark.createDataFrame([], SCHEMA), "id").publish()
    assert rows(store.read("a")) == []
    assert Snapshots(spark, store.root + "/elsewhere").manifest()["tables"] == {}
