"""Quota planning, prioritised fills, stratified and seeded samples, sharding."""
from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnowry.functions.text import normalize_lang, text_key
from winnowry.operators.windows import capped, dedupe_texts


def seeded(seed: int | str, *key: Column | str) -> Column:
    """A pseudo-random order that any engine can repeat: md5 of the seed and the key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k for k in key]))


def quotas(pool: DataFrame, n_target: int, ratio: float, share: float, primary: str, secondary: str) -> DataFrame:
    """One row: quotas and source caps of both languages, from the sizes of a deduplicated pool. Nothing is collected."""
    sizes = pool.agg(F.count_if(F.col("lang") == primary).alias("p"), F.count_if(F.col("lang") == secondary).alias("s"))
    need = F.ceil(F.lit(ratio) * n_target)
    short = F.col("p") < need
    n_eff = F.when(F.col("p") == 0, 0).when(short, F.least(F.lit(n_target), F.floor(F.col("p") / ratio)) if ratio > 0 else F.lit(0)).otherwise(n_target).cast("long")
    rows = sizes.select("p", "s", (short | (F.col("p") == 0)).alias("shortfall"), n_eff.alias("n_eff"))
    first = F.least(F.col("p"), F.ceil(F.lit(ratio) * F.col("n_eff")))
    rows = rows.withColumn("n_s", F.least(F.col("s"), F.col("n_eff") - first))
    rows = rows.withColumn("n_p", F.least(F.col("p"), F.greatest(first, F.col("n_eff") - F.col("n_s"))))
    cap = lambda n: F.when(F.col(n) > 0, F.greatest(F.lit(1), F.floor(F.lit(share) * F.col(n)))).otherwise(0)
    return rows.withColumns({"cap_p": cap("n_p"), "cap_s": cap("n_s")})


def select_quota(items: DataFrame, n_target: int, ratio: float, s_min: float, max_source_share: float, primary: str = "zh", secondary: str = "ja") -> DataFrame:
    """The best candidates under a language quota and a cap per source: text duplicates go first, then sources' extra rows, then what the quota has no room for.
    The quotas are one row, fetched first, so that a language's rows are ranked only up to its quota."""
    pool = items.where((F.col("decision") == "candidate") & (F.coalesce("score", F.lit(0.0)) >= s_min)).withColumn("lang", normalize_lang(F.col("lang")))
    pool = dedupe_texts(pool, text_key(F.col("text"))).where(F.col("lang").isin(primary, secondary)).withColumn("source_id", F.coalesce("source_id", F.lit("")))
    plan = quotas(pool, n_target, ratio, max_source_share, primary, secondary).first()
    parts = [capped(pool.where(F.col("lang") == lang), "source_id", int(plan[f"cap_{k}"]), int(plan[f"n_{k}"]), F.desc("score"), F.asc("path")) for lang, k in ((primary, "p"), (secondary, "s"))]
    return parts[0].unionByName(parts[1]).select(*items.columns)


def selection_stats(items: DataFrame, selected: DataFrame, n_target: int, ratio: float, s_min: float, share: float, primary: str = "zh", secondary: str = "ja") -> DataFrame:
    pool = items.where((F.col("decision") == "candidate") & (F.coalesce("score", F.lit(0.0)) >= s_min)).withColumn("lang", normalize_lang(F.col("lang")))
    pool = dedupe_texts(pool, text_key(F.col("text")))
    got = selected.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(normalize_lang(F.col("lang")) == primary).alias("n_primary"))
    rows = quotas(pool, n_target, ratio, share, primary, secondary).select("n_eff", "shortfall").crossJoin(got)
    return rows.select(F.lit(n_target).alias("n_target"), "n_eff", "shortfall", "n_total", "n_primary", (F.col("n_total") - F.col("n_primary")).alias("n_secondary"), F.coalesce(F.try_divide(F.col("n_primary"), F.col("n_total")), F.lit(0.0)).alias("ratio"))


def ranked(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of all in the order: partitions keep n each before they meet."""
    return rows.orderBy(*order).limit(n)


def fill(rows: DataFrame, n: int, key: str, *order: Column) -> DataFrame:
    """The first n rows of different keys, in order of priority; of equal keys the first. ``rank`` numbers them."""
    names = [f"_o{k}" for k in range(len(order))]
    keyed = rows.withColumns(dict(zip(names, order, strict=True)))
    best = keyed.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(*names)).alias("_row"), F.min(F.struct(*names)).alias("_order"))
    top = best.orderBy("_order").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("_order"))).select("_row.*", "rank")


def bottom_share(rows: DataFrame, share: float, *order: Column) -> DataFrame:
    """The first ceil(share * n) rows in the order, at least one. The number is known before the sort, which then keeps only that many."""
    n = rows.count()
    return rows.orderBy(*order).limit(max(1, -int(-(share * n) // 1))) if n else rows.limit(0)


def stratified(pools: list[tuple[str, DataFrame, int]], key: str, seed: int | str) -> DataFrame:
    """A sample without replacement over layers that overlap: each layer in turn gives up to its quota of keys that earlier layers haven't given, in seeded order. (layer, key)"""
    taken = None
    for layer, pool, quota in pools:
        free = pool.select(key).distinct()
        if taken is not None:
            free = free.join(taken.select(key), key, "left_anti")
        part = free.orderBy(seeded(seed, F.lit(layer), key), key).limit(quota).select(F.lit(layer).alias("layer"), key)
        taken = part if taken is None else taken.unionByName(part)
    return taken


def sample_per_group(rows: DataFrame, group: str, key: str, n: int, seed: int | str) -> DataFrame:
    order = Window.partitionBy(group).orderBy(seeded(seed, key), F.col(key))
    return rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def dev_split(rows: DataFrame, key: str, share: float, seed: int | str) -> DataFrame:
    """Adds ``part``: dev for max(1, int(share * n)) of the n different keys in seeded order, train for the rest and for rows without a key."""
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct()
    n = keys.count()
    dev = keys.orderBy(seeded(seed, key), key).limit(max(1, int(n * share))).withColumn("part", F.lit("dev"))
    return rows.join(dev, key, "left").withColumn("part", F.coalesce("part", F.lit("train")))


def split_sets(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Keys that both tables have."""
    return rows.select(key).intersect(other.select(key))


def balanced_shards(items: list[tuple[str, float]], n: int) -> list[list[str]]:
    """Items to shards, the heaviest first, each to the lightest shard. For driver-side lists of files; rows are balanced by Spark itself."""
    heap = [(0.0, k) for k in range(n)]
    shards: list[list[str]] = [[] for _ in range(n)]
    for name, weight in sorted(items, key=lambda x: (-x[1], x[0])):
        load, k = heapq.heappop(heap)
        shards[k].append(name)
        heapq.heappush(heap, (load + weight, k))
    return shards


def round_robin(rows: DataFrame, ordinal: str, n: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.col(ordinal), F.lit(n)).cast("int"))


def batches(rows: DataFrame, size: int, key: list[str], *order: Column) -> DataFrame:
    """Adds ``batch``: consecutive runs of ``size`` rows within each key."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1) / size))


def largest_by(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Per key the value with the largest weight, such as an audio stream by bandwidth or a partial file by size."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(weight, value)).alias(value), F.max(weight).alias(weight))


def review_queue(records: DataFrame, n: int = 180) -> DataFrame:
    """The review queue: first peak-era rows, then others, Chinese first, one row per normalised text, numbered Q0001 on.
    records: text, lang, era_tag, ordinal, key (normalised text)."""
    era = F.when(F.col("era_tag") == "peak", 0).when(F.col("era_tag") == "unknown", 1).otherwise(2)
    phase = F.when(F.col("era_tag") == "peak", 0).otherwise(1)
    picked = fill(records, n, "key", phase, era, (F.col("lang") != "zh").cast("int"), F.col("ordinal"))
    return picked.withColumn("id", F.format_string("Q%04d", F.col("rank")))


def ready_to_enable(pool: DataFrame, scenes: list[str], least: int = 40, each: int = 3) -> DataFrame:
    """One row: whether a pool has enough rows and each required scene enough of them."""
    counts = pool.select(F.explode("scenes").alias("scene")).groupBy("scene").agg(F.count(F.lit(1)).alias("n"))
    wanted = pool.sparkSession.createDataFrame([(s,) for s in scenes], "scene string")
    enough = wanted.join(counts, "scene", "left").agg(F.bool_and(F.coalesce("n", F.lit(0)) >= each).alias("scenes_ok"))
    return enough.crossJoin(pool.agg(F.count(F.lit(1)).alias("n"))).select((F.col("scenes_ok") & (F.col("n") >= least)).alias("ready"), "n")


def merge_fewshot(old: DataFrame, reviewed: DataFrame) -> DataFrame:
    """The few-shot pool that approved review rows make; it replaces the old pool of the same source, others stay. reviewed: text, final_text, lang, scenes, source, era_tag, high_conf, status."""
    from winnowry.functions.text import resolved_text

    new = reviewed.where("status = 'approved'").withColumn("text", resolved_text(F.col("final_text"), F.col("text")))
    new = new.where(F.coalesce("text", F.lit("")) != "").select("text", "lang", "scenes", "source", "era_tag", "high_conf").dropDuplicates(["text"])
    return old.join(reviewed.select("source").distinct(), "source", "left_anti").select(*new.columns).unionByName(new)
