"""Percentiles by rounds of counting against numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from winnowry.operators.aggregates import percentiles_by_selection


@pytest.mark.parametrize("leaf", [1, 10, 10**6])
def test_small_groups(spark, leaf):
    rng = np.random.default_rng(6)
    groups = {"even": np.arange(50.0), "same": np.full(40, 2.5), "steep": np.exp(rng.normal(size=200) * 6), "two": np.array([1.0, 9.0]), "one": np.array([7.0]), "ties": np.repeat([1.0, 2.0, 2.0, 3.0], 25), "signs": np.array([-1e300, -1.0, 0.0, 1e-300, 1e300])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("even", None), ("nothing", None), ("nothing", float("nan")), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r["g"]: r for r in percentiles_by_selection(df, "v", ["g"], (5, 50, 99), leaf).collect()}
    assert set(got) == {*groups, "nothing", None} and got["nothing"]["p50"] is None and got["nothing"]["n"] == 0
    for k, vs in (groups | {None: np.array([3.0])}).items():
        assert got[k]["n"] == len(vs)
        for p in (5, 50, 99):
            assert got[k][f"p{p:02d}"] == pytest.approx(np.percentile(vs, p), rel=1e-9)


def test_one_group_of_many_values(spark):
    """Three million different values; no task sorts more than a thousand of them."""
    df = spark.range(3_000_000).select(F.lit("g").alias("g"), (F.pmod(F.col("id") * 7919, F.lit(3_000_000)) * 0.5).alias("v"))
    r = percentiles_by_selection(df, "v", ["g"], (10, 50), leaf=1000).first()
    assert (r["n"], r["p10"], r["p50"]) == (3_000_000, pytest.approx(0.5 * 299_999.9), pytest.approx(0.5 * 1_499_999.5))
