"""Audits: histograms, crosstabs, percentiles, segment folds, conditional rates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnowry.sources.scratch import written

from winnowry.functions.numeric import longest_run, rms_db, variation

PERCENTS = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def histogram(rows: DataFrame, column: str = "reason", n: str = "n") -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias(n))


def reason_counts(rows: DataFrame, reasons: str = "reasons") -> DataFrame:
    """(reason, n): 'keep' and 'drop' count rows, other names count rows that have them."""
    verdict = F.when(F.size(reasons) == 0, "keep").otherwise("drop")
    return rows.select(F.explode(F.concat(F.array(verdict), F.col(reasons))).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def crosstab(rows: DataFrame, by: str, of: str, values: list[str]) -> DataFrame:
    """Counts of the values of ``of`` for each ``by``. The values are given, so the pivot needs no job of its own."""
    return rows.groupBy(by).agg(*[F.count_if(F.col(of) == v).alias(v) for v in values], F.count(F.lit(1)).alias("total"))


def percentiles(rows: DataFrame, column: str, by: list[str] | None = None, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """Exact percentiles by linear interpolation, a column pNN each. Equal values are counted before they're shuffled, so a column of few values stays small."""
    shares = F.percentile(column, F.array(*[F.lit(p / 100) for p in percents])).alias("_p")
    out = rows.groupBy(*(by or [])).agg(F.count(column).alias("n"), shares)
    return out.select(*(by or []), "n", *[F.get("_p", F.lit(k)).alias(f"p{p:02d}") for k, p in enumerate(percents)])


def order_statistics(rows: DataFrame, column: str, positions: dict[str, tuple[int, int]], ranges: int = 64) -> DataFrame:
    """Sorted values at n*a//b, not interpolated, for each name: (a, b). Exact at any size: values are counted, counts are summed over
    ranges between approximate quantiles (a few dozen rows), and ranks run within a range, so no task orders the whole column."""
    known = rows.where(F.col(column).isNotNull())
    bounds = known.approxQuantile(column, [k / ranges for k in range(1, ranges)], 0.5 / ranges)
    counts = known.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    place = F.array_size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col("v"))) if bounds else F.lit(0)
    counts = counts.withColumn("p", place)
    sums = counts.groupBy("p").agg(F.sum("k").alias("s"))
    before = sums.select("p", F.coalesce(F.sum("s").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("s").over(Window.partitionBy()).alias("n"))
    met = counts.join(F.broadcast(before), "p")  # at most ``ranges`` rows
    high = F.sum("k").over(Window.partitionBy("p").orderBy("v")) + F.col("before")
    met = met.withColumn("high", high).withColumn("low", F.col("high") - F.col("k"))
    at = {name: F.floor(F.col("n") * a / b).cast("long") for name, (a, b) in positions.items()}
    return met.agg(*[F.max(F.when((F.col("low") <= x) & (x < F.col("high")), F.col("v"))).alias(name) for name, x in at.items()])


def decision_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Overall and per group: n, kept, keep_rate, rows of equal texts among kept ones, mean and least similarity of kept ones, share of at least 0.95. Nulls in ``by`` columns mark the total."""
    kept = F.col("decision") == "keep"
    same = F.col("sim_ab") >= 1.0
    out = rows.groupingSets([[], [F.col(c) for c in by]], *by) if by else rows.groupBy()
    return out.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("kept"), (F.count_if(kept) / F.count(F.lit(1))).alias("keep_rate"),
        F.try_divide(F.count_if(kept & same), F.count_if(kept)).alias("identical_rate"), F.avg(F.when(kept, F.col("sim_ab"))).alias("mean_sim"),
        F.min(F.when(kept, F.col("sim_ab"))).alias("min_sim"), F.try_divide(F.count_if(kept & (F.col("sim_ab") >= 0.95)), F.count_if(kept)).alias("rate_095"),
    )


def tier_map(rows: DataFrame, by: str) -> DataFrame:
    """For each ``by`` a map of tier to rows."""
    each = rows.groupBy(by, "tier").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tier", "n")))).alias("tiers"))


def segment_record(segments: Column) -> Column:
    """Fold of an array of segments: text joined, log probability weighted by duration (at least 0.01 s; nulls left out), largest no-speech probability and compression ratio, number."""
    timed = F.filter(segments, lambda s: s["avg_logprob"].isNotNull())
    weight = lambda s: F.greatest(s["end"] - s["start"], F.lit(0.01))
    total = F.aggregate(timed, F.lit(0.0), lambda a, s: a + weight(s))
    weighted = F.aggregate(timed, F.lit(0.0), lambda a, s: a + weight(s) * s["avg_logprob"])
    return F.struct(
        F.trim(F.array_join(F.transform(segments, lambda s: s["text"]), "")).alias("text"),
        F.try_divide(weighted, F.when(F.size(timed) > 0, total)).alias("avg_logprob"),
        F.array_max(F.transform(segments, lambda s: s["no_speech_prob"])).alias("max_no_speech_probability"),
        F.array_max(F.transform(segments, lambda s: s["compression_ratio"])).alias("max_compression_ratio"),
        F.size(segments).alias("segment_count"),
    )


def clip_summary(rows: DataFrame) -> DataFrame:
    """(kind, name, n): totals, kept and dropped rows, tiers of kept rows, and reasons."""
    total = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("reasons") == 0).alias("keep"), F.count_if(F.size("reasons") > 0).alias("drop"))
    rows_of = total.select(F.explode(F.create_map(*[x for c in ("total", "keep", "drop") for x in (F.lit(c), F.col(c))])).alias("name", "n")).select(F.lit("rows").alias("kind"), "name", "n")
    tiers = rows.where(F.size("reasons") == 0).groupBy(F.col("tier").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("tier").alias("kind"), "name", "n")
    why = rows.select(F.explode("reasons").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.lit("reason").alias("kind"), "name", "n")
    return rows_of.unionByName(tiers).unionByName(why)


def estimated_clips(plan: DataFrame, target: int, per_hour: dict[str, float]) -> DataFrame:
    """One row: estimated clips of a plan by tier's yield, and whether they fall short of the target."""
    rate = F.lit(0.0)
    for tier, value in per_hour.items():
        rate = F.when(F.col("tier") == tier, F.lit(float(value))).otherwise(rate)
    estimate = F.coalesce(F.sum(F.col("duration") / 3600.0 * rate), F.lit(0.0))
    return plan.agg(estimate.alias("estimate")).withColumn("shortfall", F.col("estimate") < target)


def progress(stages: DataFrame) -> DataFrame:
    """Per stage: hours, rows, latest change, and whether an earlier stage changed after it. stages: stage, step (order), duration, mtime."""
    each = stages.groupBy("stage", "step").agg((F.sum("duration") / 3600).alias("hours"), F.count(F.lit(1)).alias("n"), F.max("mtime").alias("latest"))
    earlier = F.max("latest").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1))  # as many rows as stages
    return each.withColumn("stale", F.coalesce(earlier > F.col("latest"), F.lit(False)))


def frame_features(frames: DataFrame) -> DataFrame:
    """voiced_ratio, longest_voiced (seconds) and f0_cv (over the longest voiced run) of tracks: f0 (NaN or null: none), voiced, sr, hop."""
    rows = frames.withColumn("_run", longest_run(F.col("voiced")))
    pitch = F.filter(F.slice("f0", F.col("_run.start") + 1, F.col("_run.length")), lambda x: x.isNotNull() & ~F.isnan(x))
    ratio = F.try_divide(F.size(F.filter("voiced", lambda v: F.coalesce(v, F.lit(False)))).cast("double"), F.size("voiced").cast("double"))
    return rows.withColumns({"voiced_ratio": F.coalesce(ratio, F.lit(0.0)), "longest_voiced": F.col("_run.length") * F.col("hop") / F.col("sr"), "f0_cv": variation(pitch)}).drop("_run")


def with_energy(rows: DataFrame, samples: str = "samples") -> DataFrame:
    return rows.withColumn("rms_db", rms_db(F.col(samples)))


def distinct_sizes(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def most_frequent_share(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, share): the most frequent non-space character's share of each text, by exploding; for texts of any length."""
    chars = rows.select(key, F.explode(F.split(F.regexp_replace(text, r"(?U)\s", ""), "")).alias("c")).where("c <> ''")
    each = chars.groupBy(key, "c").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(key).agg((F.max("n") / F.sum("n")).alias("share"))


#: Values of an interval that are sorted in one task, buckets that a larger one is counted in, and intervals that are broadcast.
LEAF_VALUES, FAN, MOST_BROADCAST = 100_000, 1024, 100_000


def percentiles_by_selection(rows: DataFrame, value: str, keys: list[str], percents: tuple[int, ...] = PERCENTS, leaf: int = LEAF_VALUES) -> DataFrame:
    """What ``percentiles`` gives, for groups of any size and any number of different values: each wanted rank lies in an interval of its group; intervals with more than ``leaf`` values are
    counted in buckets, round by round, and give way to the bucket with the rank, from its least to its largest value. Then only what lies in the last intervals is sorted. Nulls and NaN aren't
    values; a group of them has nulls."""
    rows = rows.select(F.struct(*keys).alias("key"), F.col(value).cast("double").alias("v"))
    rows = written(rows.withColumn("v", F.when(~F.isnan("v"), F.col("v"))), "values")
    groups = written(rows.groupBy("key").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "groups")
    at = (F.col("n") - 1) * F.col("p") / 100
    asked = groups.where("n > 0").select("key", "n", "low", "high", F.explode(F.array(*map(F.lit, percents))).alias("p")).withColumn("at", at)
    ranks = asked.select("key", "n", "low", "high", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank")).distinct()
    open_ = written(ranks.select("key", "rank", "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("m")), "ranks")
    done, wide = [], (F.col("m") > leaf) & (F.col("low") < F.col("high"))
    while True:
        done.append(open_.where(~wide))
        open_ = open_.where(wide)
        intervals = open_.select("key", "low", "high").distinct()
        many = intervals.count()
        if not many:
            break
        met = rows.join(F.broadcast(intervals) if many <= MOST_BROADCAST else intervals, "key").where(F.col("v").between(F.col("low"), F.col("high")))
        bucket = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * FAN), F.lit(FAN - 1))
        counts = met.groupBy("key", "low", "high", bucket.alias("b")).agg(F.count(F.lit(1)).alias("k"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.coalesce(F.sum("k").over(Window.partitionBy("key", "low", "high").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        narrow = open_.join(counts.withColumn("before", before), ["key", "low", "high"]).where((F.col("rank") >= F.col("below") + F.col("before")) & (F.col("rank") < F.col("below") + F.col("before") + F.col("k")))
        open_ = written(narrow.select("key", "rank", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("below") + F.col("before")).alias("below"), F.col("k").alias("m")), "ranks")
    last = done[0]
    for part in done[1:]:
        last = last.unionByName(part)
    last = written(last, "last")
    spread = last.where("low < high").select("key", "low", "high").distinct()
    inside = rows.join(spread, "key").where(F.col("v").between(F.col("low"), F.col("high"))).groupBy("key", "low", "high").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    found = last.join(inside, ["key", "low", "high"], "left").select("key", "rank", F.coalesce(F.get("vs", (F.col("rank") - F.col("below")).cast("int")), F.col("low")).alias("v"))
    one, two = (found.select("key", F.col("rank").alias(r), F.col("v").alias(v)) for r, v in (("r1", "v1"), ("r2", "v2")))
    each = asked.withColumns({"r1": F.floor("at"), "r2": F.ceil("at")}).join(one, ["key", "r1"]).join(two, ["key", "r2"])
    each = each.groupBy("key").agg(*[F.max(F.when(F.col("p") == p, F.col("v1") + (F.col("v2") - F.col("v1")) * (F.col("at") - F.col("r1")))).alias(f"p{p:02d}") for p in percents])
    return groups.select("key", "n").join(each, "key", "left").select("key.*", "n", *[f"p{p:02d}" for p in percents])
