"""Intermediate tables in the folder that driver and executors share (``spark.checkpoint.dir``)."""
from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only a one-machine session may make its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not getattr(spark.sparkContext, "_winnowry_dir", None):
        spark.sparkContext._winnowry_dir = "file://" + tempfile.mkdtemp(prefix="winnowry-")
        remove_at_exit(spark, spark.sparkContext._winnowry_dir)
    return spark.sparkContext._winnowry_dir


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    def go() -> None:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the JVM may be gone by then
            pass

    atexit.register(go)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/winnowry/{name}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows once written to the shared folder: what is computed from them later sees the same rows in the same places."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
