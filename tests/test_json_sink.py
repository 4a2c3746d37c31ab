"""Arrays that are written row by row, and read again."""
import pathlib

import __spark_entry__
from pyspark.sql import functions as F

from winnowry.sources import scratch, sinks
from winnowry.sources.readers import read_json_array


def test_arrays_hold_every_row(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "]}', None), (None, None, 2.5), (3, "", 0.0), (4, "x" * 3000, 1.0)], "k long, s string, v double").repartition(3)
    for n, (some, head, tail, depth) in enumerate([(rows, "[", "]", 1), (rows, '{"a": "}[", "items": [', "]}", 2), (rows.repartition(9, "k"), '{"a": "}[", "items": [', "]}", 2), (rows.where("false"), "[", "]", 1)]):
        sinks.write_json_arrays(some, str(tmp_path / str(n)), head, tail)
        got = read_json_array(spark, str(tmp_path / str(n)), "k long, s string, v double", depth).drop("ordinal")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, some.collect()), key=repr)


def test_no_row_holds_a_group_of_documents(spark, tmp_path):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit(500).cast("long").alias("n_chars"), F.repeat(F.lit("text "), 100).alias("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert __spark_entry__.queries()["q_json_forms"](spark, str(tmp_path)).count() == 6000
    folder = pathlib.Path(scratch.shared_dir(spark).removeprefix("file://")) / "winnowry"
    for name in ("arrays", "items"):
        newest = max(folder.glob(f"{name}-*"), key=lambda x: x.stat().st_mtime)
        found = spark.read.text(str(newest)).agg(F.max(F.length("value")), F.sum(F.length("value"))).first()
        assert found[0] < 1000 and found[1] > 1_000_000
