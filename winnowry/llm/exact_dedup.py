"""Exact dedup over a persistent digest index.

The index is a parquet table bucketed and sorted by digest. A batch is digested in the scan, reduced to one row
a digest by a combining aggregate, anti-joined with the index by sort-merge (the index side is read bucket by
bucket, without a shuffle), and the new digests are appended, one file a bucket. Everything runs as DataFrame
operations.

Defined results:
* a null text equals the empty text; extra columns of the input are ignored;
* within a batch the row with the largest id stays (null ids last); of repeated rows of that id, one;
* a digest that an earlier batch brought stays with that batch's survivor, and no row of the new batch is kept;
* a batch that is run again under its name, after its driver failed at any point, gives the result of its first run;
* an index that holds another number of buckets than asked for is an error;
* an empty table gives an empty result and leaves the index as it was.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import materialise, partitions, scratch_path

#: A digest with more than this share of a batch is hot. There are at most 1/HOT_SHARE such digests, which bounds the broadcast.
HOT_SHARE = 1e-3


def digest(text) -> F.Column:
    """sha2-256 of the text's UTF-8 bytes, as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class DigestIndex:
    """A table (digest, keep_id, batch) in ``path``, in ``n_buckets`` buckets. ``n_buckets`` belongs to the index for its life; a mark beside its files tells it."""

    def __init__(self, spark: SparkSession, path: str, n_buckets: int, name: str | None = None):
        self.spark, self.path, self.n_buckets = spark, path, n_buckets
        self.table = name or "digest_index_" + path.rstrip("/").rpartition("/")[2].replace("-", "_")
        self._check_buckets()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {n_buckets} BUCKETS LOCATION '{path}'"
        )

    def _check_buckets(self) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        folder = where(self.path)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        held = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        marks = [n for n in held if n.startswith("_buckets=")]
        if any(n != f"_buckets={self.n_buckets}" for n in marks) or (held and not marks):
            raise ValueError(f"{self.path} holds {marks or 'files of unknown buckets'}, not {self.n_buckets} buckets")
        files.mkdirs(where(f"{self.path}/_buckets={self.n_buckets}"))

    def forget(self) -> None:
        """Take the table out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame) -> None:
        """Add digests that the index lacks. Spark's commit makes a file appear whole or not at all; a repeated batch adds nothing, as it's anti-joined first."""
        (
            fresh.select("digest", "keep_id", "batch").repartition(self.n_buckets, "digest").sortWithinPartitions("digest")
            .write.mode("append").format("parquet").bucketBy(self.n_buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)
        )

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Deduplicate a batch against the index and itself, append what is new, and return one row per input row:
        id, keep_id, group_size (rows of this batch with the text), kept, text_sha256. A named batch may be run again."""
        batch = batch or uuid.uuid4().hex
        seen = materialise(docs.select(F.col(id_col).cast("long").alias("id"), digest(F.col(text_col)).alias("digest")).withColumn("row", F.monotonically_increasing_id()), "digests")
        last = F.max(F.struct("id", "row"))
        groups = materialise(seen.groupBy("digest").agg(last.alias("last"), F.count(F.lit(1)).alias("group_size")).select("digest", F.col("last.id").alias("keep_id"), F.col("last.row").alias("keep_row"), "group_size"), "groups")
        known = self.rows().hint("merge")
        fresh = groups.join(known.select("digest"), "digest", "left_anti").withColumn("batch", F.lit(batch))
        stay = groups.join(known.select("digest", F.col("keep_id").alias("first_id"), F.col("batch").alias("first_batch")), "digest", "left")
        own = F.coalesce(F.col("first_batch") == batch, F.lit(True))  # this batch's, now or in an earlier run of it
        stay = materialise(stay.select("digest", F.when(own, F.col("keep_id")).otherwise(F.col("first_id")).alias("keep_id"), F.when(own, F.col("keep_row")).alias("keep_row"), "group_size"), "stay")
        self.append(fresh)
        return self._assign(seen, stay, id_col)

    def _assign(self, seen: DataFrame, stay: DataFrame, id_col: str) -> DataFrame:
        """Each row's survivor. Rows of hot digests meet their few survivors by broadcast and aren't shuffled; the others are joined by sort-merge."""
        total = seen.count()
        hot = stay.where(F.col("group_size") > F.lit(HOT_SHARE) * total)
        near = seen.join(F.broadcast(hot), "digest")
        far = seen.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(stay.where(F.col("group_size") <= F.lit(HOT_SHARE) * total).hint("merge"), "digest")
        return near.unionByName(far).select(
            F.col("id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
        )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_buckets: int | None = None) -> DataFrame:
    """Deduplicate one table with an index of its own, in the shared folder."""
    spark = docs.sparkSession
    index = DigestIndex(spark, scratch_path(spark, "digest_index"), n_buckets or partitions(spark))
    out = index.ingest(docs, id_col, text_col)
    index.forget()  # the result reads written tables, not the index
    return out
