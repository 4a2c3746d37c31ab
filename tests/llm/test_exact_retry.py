"""A batch of exact dedup that is run again, and the bucket count of an index."""
import pytest

from winnowry.llm import exact_dedup
from winnowry.llm._store import scratch_path


def test_a_batch_run_again_keeps_its_survivors(spark):
    path = scratch_path(spark, "digest_index")
    index = exact_dedup.DigestIndex(spark, path, 4)
    one = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "")], "doc_id long, text string")
    two = spark.createDataFrame([(9, "a"), (8, "c"), (7, "c")], "doc_id long, text string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    first, second = rows(index.ingest(one, batch="one")), rows(index.ingest(two, batch="two"))
    assert [r[0] for r in first if r[3]] == [2, 3, 5] and [r[0] for r in second if r[3]] == [8]
    index.forget()
    again = exact_dedup.DigestIndex(spark, path, 4)
    assert rows(again.ingest(one, batch="one")) == first and rows(again.ingest(two, batch="two")) == second
    assert again.rows().count() == 4
    assert not any(r["kept"] for r in again.ingest(one, batch="three").collect())


def test_another_number_of_buckets_is_an_error(spark):
    path = scratch_path(spark, "digest_index")
    exact_dedup.DigestIndex(spark, path, 4).forget()
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, 8)
