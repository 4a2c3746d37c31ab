"""Ranked picks and running sums. Every order ends in a natural key, so ties have one result on any cluster."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnowry.sources.scratch import written


def best_per_key(rows: DataFrame, key: list[str | Column], *order: Column) -> DataFrame:
    """The first row of each key in the order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_per_key(rows: DataFrame, key: list[str], n: int | Column, *order: Column, name: str | None = None) -> DataFrame:
    """The first n rows of each key in the order, with their numbers from 1 if these are named."""
    top = rows.withColumn(name or "_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(name or "_rn") <= n)
    return top if name else top.drop("_rn")


def dedupe_texts(rows: DataFrame, key: Column) -> DataFrame:
    """Of rows with equal text keys the best score, then the smallest path; an empty key is a key of its own row. By a
    combining aggregate: a key that very many rows share is reduced before it's shuffled."""
    keyed = rows.withColumn("_key", F.when(key == "", F.concat(F.lit("\0"), F.col("path"))).otherwise(key))
    best = keyed.groupBy("_key").agg(F.min_by(F.struct(*rows.columns), F.struct(-F.coalesce("score", F.lit(0.0)), F.col("path"))).alias("_row"))
    return best.select("_row.*")


def longest_per_id(rows: DataFrame) -> DataFrame:
    """The longest record of each id, the first of equals."""
    return best_per_key(rows, ["source_id"], F.desc("duration"), F.asc("ordinal"))


def best_stream_per_date(rows: DataFrame, priority: Column) -> DataFrame:
    """Of a date's streams the preferred uploader's, then the longest, then the first; streams without a date stand for themselves."""
    key = F.coalesce("stream_date", F.concat(F.lit("id:"), "source_id"))
    return best_per_key(rows.withColumn("_key", key), ["_key"], priority.desc(), F.desc("duration"), F.asc("ordinal")).drop("_key")


def capped(rows: DataFrame, source: str, cap: int, n: int, *order: Column) -> DataFrame:
    """The first n rows in the order that are among the first ``cap`` of their source: the greedy choice under a cap. Both limits
    are literals, so partitions keep no more rows than these before they meet."""
    within = rows.withColumn("_s", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where(F.col("_s") <= cap)
    return within.orderBy(*order).limit(n).drop("_s")


def in_order(rows: DataFrame, *order: Column, amount: Column | None = None) -> DataFrame:
    """Adds ``_place``, each row's number from 1 in one order over all rows, and with an amount ``_before``, the sum of those before it. Rows are
    sorted by ranges of the order and written; counts and sums of the ranges, a row each, give where a range begins, so no task holds all rows."""
    sorted_ = rows.withColumn("_amount", F.lit(0) if amount is None else amount).repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_ = written(sorted_.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ordered")
    ranges = sorted_.groupBy("_range").agg(F.count(F.lit(1)).alias("_k"), F.sum("_amount").alias("_s"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    ranges = ranges.select("_range", F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_k"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s"))
    met = sorted_.join(F.broadcast(ranges), "_range").withColumn("_place", F.col("_k") + F.col("_at") + 1)
    if amount is not None:
        within = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        met = met.withColumn("_before", F.col("_s") + F.coalesce(F.sum("_amount").over(within), F.lit(0)))
    return met.drop("_amount", "_range", "_at", "_k", "_s")


def running_budget(rows: DataFrame, key: list[str], amount: str, most: float, *order: Column, inclusive: bool = True) -> DataFrame:
    """Rows of each key, in order, while a running sum keeps within a budget: with their own amount (the first always stays), or
    if not inclusive while the sum of the rows before is below the budget. Adds ``running``."""
    window = Window.partitionBy(*key).orderBy(*order)
    total = F.sum(amount).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("running", total).withColumn("_rn", F.row_number().over(window))
    keep = (F.col("_rn") == 1) | (F.col("running") <= most) if inclusive else F.col("running") - F.col(amount) < most
    return rows.where(keep).drop("_rn")


def first_occurrences(rows: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    return best_per_key(rows, [key], F.asc(ordinal))


def with_sequence(rows: DataFrame, form: str, key: list[str], *order: Column, name: str = "id") -> DataFrame:
    return rows.withColumn(name, F.format_string(form, F.row_number().over(Window.partitionBy(*key).orderBy(*order))))


def islands(frames: DataFrame, key: str, at: str, flag: str) -> DataFrame:
    """The longest run of true flags per key from one row per frame: (key, start, length), the first of equals."""
    gap = F.row_number().over(Window.partitionBy(key).orderBy(at)) - F.row_number().over(Window.partitionBy(key, flag).orderBy(at))
    runs = frames.withColumn("_g", gap).where(F.col(flag)).groupBy(key, "_g").agg(F.min(at).alias("start"), F.count(F.lit(1)).alias("length"))
    return runs.groupBy(key).agg(F.max_by(F.struct("start", "length"), F.struct("length", -F.col("start"))).alias("_r")).select(key, "_r.*")
