"""Line and near dedup read texts in batches of bounded bytes."""
import pyarrow as pa
import pytest

from winnowry.llm import _store, line_dedup, minhash_dedup

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize(("module", "run"), [(line_dedup, line_dedup.drop_lines), (minhash_dedup, minhash_dedup.drop_near_duplicates)])
def test_tables_of_texts_are_written_in_small_batches(spark, monkeypatch, module, run):
    seen, before = set(), spark.conf.get(LIMIT)
    monkeypatch.setattr(module, "materialise", lambda df, name: (seen.add((name, spark.conf.get(LIMIT))), _store.materialise(df, name))[1])
    texts = ["a b c d e f g h\ni j k l m n o p", "a b c d e f g h\nq r s t u v w x", "a b c d e f g h\ni j k l m n o p", None, ""]
    rows = run(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    first = {"lines", "partners", "sketches", "likely"}
    assert {limit for name, limit in seen if name in first} == {str(_store.BATCH_BYTES)} and spark.conf.get(LIMIT) == before
    left = {r["doc_id"]: r["text"] for r in rows}
    assert left == ({0: texts[0], 1: "q r s t u v w x", 2: "", 3: None, 4: ""} if module is line_dedup else {0: texts[0], 1: texts[1], 3: None, 4: ""})


def test_small_batches_bound_what_a_worker_gets(spark):
    def go(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["bytes"])

    texts = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 10000) AS text")
    with _store.small_batches(spark):
        sent = [r["bytes"] for r in texts.mapInArrow(go, "bytes long").collect()]
    assert max(sent) < 1.1 * _store.BATCH_BYTES and sum(sent) >= 30_000_000
