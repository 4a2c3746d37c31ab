"""Intermediate tables in the folder that all executors share."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from winnowry.sources import scratch

#: Scratch paths of this driver, in the order they were made.
_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends, or with ``staged`` before."""
    _made.append(scratch.scratch_path(spark, name))
    return _made[-1]


def materialise(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write a table to the shared folder, in folders by some columns if given, and read it back: it cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str, n: int) -> DataFrame:
    """Write a table to the shared folder in n buckets by a column, and read it back: what groups by the column later doesn't shuffle it. Each task
    writes its own rows; the catalog forgets the table when the driver ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    df.write.format("parquet").bucketBy(n, column).option("path", path).saveAsTable(table)
    return spark.table(table)


def staged(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` returns, written; the scratch tables that were made for it are removed."""
    before = len(_made)
    out = materialise(build(), name)
    for path in _made[before:-1]:
        scratch.remove(spark, path)
    del _made[before:-1]
    return out


#: Bytes that Spark sends to a worker at once within ``small_batches``; a longer row is sent alone.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile goes to the workers in batches of bounded bytes, whatever the texts' lengths: 10 000 texts at once are held several times over, in the JVM and in the worker."""
    before = spark.conf.get(_LIMIT, None)
    spark.conf.set(_LIMIT, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_LIMIT, before) if before is not None else spark.conf.unset(_LIMIT)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key with more than this share of the rows is hot. There are at most 1/HOT_SHARE such keys, which bounds what is broadcast.
HOT_SHARE = 1e-3


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row per key and in ``weight`` the number of left rows with it; ``total``: rows of left.
    Rows of hot keys meet their few partners by broadcast and aren't shuffled; the others are joined by sort-merge.
    Both tables are read twice: pass written ones."""
    from pyspark.sql import functions as F

    most = F.lit(HOT_SHARE * max(total, 1))
    hot = F.broadcast(right.where(F.col(weight) > most))
    rest = right.where(F.col(weight) <= most)
    near = left.join(hot, key)
    far = left.join(hot.select(key), key, "left_anti").join(rest.hint("merge"), key, how)
    return near.unionByName(far)
