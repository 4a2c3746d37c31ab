"""Windows and joins on event time, for streams under watermarks and for batches alike."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def session_windows(events: DataFrame, gap: str, late: str, *keys: str) -> DataFrame:
    """(keys, start, end, n, total): bursts of events of a key, each less than ``gap`` after the one before; ``end`` is the last event's time plus the gap."""
    each = events.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return each.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sliding_counts(events: DataFrame, size: str, slide: str, late: str, *keys: str) -> DataFrame:
    """(keys, start, n, total) for windows of ``size`` that begin every ``slide``; an event counts in each window that covers it."""
    each = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return each.select(*keys, F.col("w.start").alias("start"), "n", "total")


def followed_within(first: DataFrame, then: DataFrame, key: str, within: str, late: str, condition: Column | None = None) -> DataFrame:
    """Pairs (key, first_id, first_ts, then_id, then_ts): events (key, id, ts) of ``then`` at most ``within`` after one of ``first``, not before it. Both sides
    forget rows that no later row can meet, so state stays as large as the interval."""
    a = first.select(F.col(key), F.col("id").alias("first_id"), F.col("ts").alias("first_ts")).withWatermark("first_ts", late)
    b = then.select(F.col(key).alias("then_key"), F.col("id").alias("then_id"), F.col("ts").alias("then_ts")).withWatermark("then_ts", late)
    met = (F.col(key) == F.col("then_key")) & (F.col("then_ts") >= F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, met if condition is None else met & condition).drop("then_key")


def each_once(events: DataFrame, within: str, *keys: str) -> DataFrame:
    """The first event of each key; a stream forgets a key once ``within`` has passed since."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))
