"""What line and near dedup leave in workers and send to them."""
import pytest
from pyspark.sql import functions as F

from winnowry.llm import line_dedup, minhash_dedup, packing
from winnowry.llm._arrow import remembered
from winnowry.llm.queries import TOKENIZER


@pytest.mark.parametrize("scan", [lambda docs: minhash_dedup.sketches(docs, "doc_id", "text"), lambda docs: line_dedup.lines_of(line_dedup._texts(docs, "doc_id", "text"))])
def test_a_scan_drops_what_packing_loaded(spark, monkeypatch, scan):
    task = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, go, schema: task.append(go))
    scan(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert packing.encoder(TOKENIZER) is packing.encoder(TOKENIZER) and remembered
    list(task[0](iter([])))
    assert not remembered


def test_rows_that_stay_do_not_pass_through_python(spark):
    texts = [None, "", " \t\n\x0b\f\r ", " \n", "\x1c", " ", "a b c d e f g", "A  b\nc d e f g", "a b c d e f g", "h i"]
    ids = [1, 2, 3, 3, 4, 5, 6, 6, 7, None]
    table = spark.createDataFrame(list(zip(ids, texts, range(10), strict=True)), "doc_id long, text string, t long")
    kept = minhash_dedup.drop_near_duplicates(table.union(table.where("t > 6")))
    assert "MapInArrow" not in kept._jdf.queryExecution().executedPlan().toString()
    got = kept.select("t").collect()
    assert sorted(r["t"] for r in got if r["t"] not in (6, 7)) == [0, 1, 2, 3, 4, 5, 9] and len(got) == 8
    assert kept.where(F.col("t").isin(6, 7)).count() == 1
