"""Cross-source maxima of whole tables against brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from winnowry.operators import speaker
from winnowry.plans.registry import QUERIES


def brute(keys, sources, vectors):
    want = {}
    for key, source, v in zip(keys, sources, vectors, strict=True):
        best = [np.max(vectors[sources == other] @ v) for other in np.unique(sources) if other != source]
        want[key] = np.median(best)
    return want


@pytest.mark.parametrize("block", [speaker.BLOCK, 17])
def test_every_vector_meets_all_of_other_sources(spark, block):
    rng = np.random.default_rng(11)
    x, sources = rng.normal(size=(200, 6)), np.array([0] * 110 + [1] * 50 + [2] * 25 + [3] * 15)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, int(s), v.tolist()) for k, (s, v) in enumerate(zip(sources, x, strict=True))]
    odd = [(900, None, x[0].tolist()), (901, 1, None), (902, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, 2, [1.0, 0.0])]
    table = spark.createDataFrame(rows + odd, "key long, source long, vector array<double>")
    got = {r["key"]: r["score"] for r in speaker.cross_source_all(table, block=block).collect()}
    want = brute(range(200), sources, x)
    assert set(got) == {*want, 901, 902, 903} and got[901] is got[902] is got[903] is None
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert speaker.cross_source_all(table.limit(0)).count() == 0


def test_query_scores_the_whole_table(spark):
    d = "/root/testdata/sf0.01"
    raw = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).collect()
    x = np.array([r["v"] for r in raw])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    want = brute([r["vec_id"] for r in raw], np.array([r["label"] for r in raw]), x)
    got = {r["key"]: r["score"] for r in QUERIES["q_cross_source_max"](spark, d).collect()}
    assert len(got) == len(raw) == 500
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_both_ways_of_medians_agree(spark):
    rows = [("a", "s1", [1.0, 0.0]), ("b", "s2", [0.0, 1.0]), ("c", "s3", [0.6, 0.8]), ("null", "s1", None), ("holds null", "s2", [None, 1.0]), ("short", "s2", [1.0]), ("no source", None, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "key string, source string, vector array<double>")
    centres = speaker.centroids(vectors.where("key IN ('a', 'b', 'c')"))
    one, two = ({r["key"]: round(r["score"], 9) for r in speaker.median_against_centroids(vectors, centres, matrix_bytes=n).collect()} for n in (1 << 20, 0))
    assert one == two and set(one) == {"a", "b", "c"}
