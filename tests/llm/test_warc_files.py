"""Archive files, rows without id and very large ids."""
import gzip

from pyspark.sql import functions as F

from winnowry.llm import warc


def test_files_are_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "<p>" + "é" * k + "</p>") for k in range(5)], "page_id long, url string, html string")
    records = [r[0].encode() for r in pages.orderBy("page_id").select(warc.record_text(F.col("url"), F.col("html"))).collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    for name in ("a.warc", "b.warc.gz"):
        rows = sorted((r["offset"], r["length"], r["url"], bytes(r["body"]).decode()) for r in got if r["path"].endswith(name))
        assert [r[2:] for r in rows] == [(f"http://h/{k}", "<p>" + "é" * k + "</p>") for k in range(5)]
        assert [r[1] for r in rows] == list(map(len, records)) and [r[0] for r in rows] == [sum(map(len, records[:k])) for k in range(5)]


def test_ids_beyond_doubles_and_rows_without_id(spark):
    big = (1 << 60) + 3
    pages = spark.createDataFrame([(big, "u", "x"), (big + 1, "v", "y" * 100_000), (None, "w", "z"), (None, None, None)], "page_id long, url string, html string")
    other = pages.withColumn("html", F.when(F.col("page_id") == big, "changed").otherwise(F.col("html")))
    got = {r["page_id"]: r for r in warc.fixity(pages, other).collect()}
    assert set(got) == {big, big + 1, -1} and got[-1]["n_records"] == 2 and got[-1]["status"] == "ok"
    assert got[big]["status"] == "corrupt" and got[big + 1]["status"] == "moved"
    assert got[big]["file"] == big // warc.SLOTS and got[big]["slot"] == big % warc.SLOTS
