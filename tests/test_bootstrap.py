"""The bootstrap's draws are the same on any engine, and scores the same by either way."""
import hashlib

import numpy as np
import pytest

from winnowry.operators import speaker


def test_means(spark):
    rng = np.random.default_rng(2)
    c = rng.normal(size=(7, 5))
    centres = spark.createDataFrame([(f"s{k}", 1, c[k].tolist()) for k in range(7)], "source string, n long, centroid array<double>").repartition(3)
    got = {r["resample"]: r["mean"] for r in speaker.bootstrap_means(centres, 11, 9).collect()}
    for r in range(9):
        drawn = [int(hashlib.md5(f"11|{r}|{j}".encode()).hexdigest()[:8], 16) % 7 for j in range(7)]
        mean = c[drawn].mean(0)
        assert got[r] == pytest.approx((mean / np.linalg.norm(mean)).tolist())


def test_scores_by_either_way(spark):
    rng = np.random.default_rng(3)
    unit = lambda n: [(x / np.linalg.norm(x)).tolist() for x in rng.normal(size=(n, 4))]
    vectors = spark.createDataFrame([(k, v) for k, v in enumerate(unit(20))], "key long, vector array<double>")
    centres = spark.createDataFrame([(f"s{k}", v) for k, v in enumerate(unit(6))], "source string, centroid array<double>")
    one, two = ({r["key"]: (round(r["score"], 9), {k: round(v, 9) for k, v in r["source_scores"].items()}) for r in speaker.source_scores(vectors, centres, n).collect()} for n in (1 << 20, 0))
    assert one == two and len(one) == 20
