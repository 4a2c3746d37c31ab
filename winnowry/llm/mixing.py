"""Mixing sources by temperature.

A source's share p of all tokens becomes a weight proportional to p^a. The exponent a is the largest (nearest to natural
shares) at which the weights' entropy still reaches a target, or, where that would repeat a source more than a limit,
the smallest within the limit. It's found on a grid of 2^-20 by narrowing an interval: each round one aggregate over the
table of sources tries 16 exponents, so the driver sees 16 rows' worth of sums, never the sources.

A weight times the budget is a source's quota of tokens: whole passes over the source, then the head of a permutation.
The permutation is by blocks: a document's block comes from a hash, blocks are summed first, and a document's place is
its block's start plus its place within the block. So no task orders more than a block, whatever a source holds.

All of it is DataFrame operations.

Defined results: a null source is the source ''; null text has no tokens; documents without tokens are kept once;
repeated rows are separate documents; where no document has tokens all weights are null; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import materialise

GRID = 1 << 20
TRIES = 16
#: Documents that a block has on average.
BLOCK_DOCS = 2000
#: The weights' entropy reaches this share of the entropy of equal weights.
TARGET_ENTROPY = 0.97
#: No source is read more often than this.
MAX_REPEATS = 4.0
SEED = "mix"
TOKEN = r"[^\x20\x09-\x0D]+"


def tokens_of(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def exponent(sources: DataFrame, target_entropy: float, max_repeats: float, budget_share: float) -> float:
    """sources: (source, tokens), all with tokens. Both conditions are monotone in the exponent."""
    total, n = sources.agg(F.sum("tokens").cast("double"), F.count(F.lit(1)).cast("double")).first()
    if not n:
        return 1.0
    p = F.col("tokens") / F.lit(total)

    def narrow(holds, low: int, high: int, rising: bool) -> int:
        """The last grid point in [low, high] at which the condition holds if it holds from low on; with rising, the first one if it holds up to high."""
        while high - low > 1:
            points = sorted({low + (high - low) * k // TRIES for k in range(1, TRIES)} - {low, high})
            sums = [x for j, k in enumerate(points) for x in (F.sum(F.pow(p, F.lit(k / GRID))).alias(f"z{j}"), F.sum(F.pow(p, F.lit(k / GRID)) * F.log(p)).alias(f"s{j}"), F.max(F.pow(p, F.lit(k / GRID - 1))).alias(f"m{j}"))]
            row = sources.agg(*sums).first()
            true = [k for j, k in enumerate(points) if holds(k / GRID, row[f"z{j}"], row[f"s{j}"], row[f"m{j}"])]
            if rising:
                high = min(true, default=high)
                low = max([k for k in points if k < high], default=low)
            else:
                low = max(true, default=low)
                high = min([k for k in points if k > low], default=high)
        return high if rising else low

    from math import log

    even = lambda a, z, s, m: log(z) - a * s / z >= target_entropy * log(n)
    few = lambda a, z, s, m: budget_share * m / z <= max_repeats
    by_entropy = narrow(even, 0, GRID + 1, False)
    by_repeats = narrow(few, -1, GRID, True)
    return max(min(by_entropy, GRID), by_repeats, 0) / GRID


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget_share: float = 1.0, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, source, n_tokens, weight, repeats (passes over the source, a fraction too), copies (how often
    this document is read), block, start (tokens of the permutation before it), and the columns of ``carry``."""
    light = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), tokens_of(F.col(text_col)).alias("n_tokens"), *carry)
    if not carry:
        light = materialise(light, "tokens")
    sources = materialise(light.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")), "sources")
    some = sources.where("tokens > 0")
    a = exponent(some, target_entropy, max_repeats, budget_share)
    total = F.lit(float(some.agg(F.sum("tokens")).first()[0] or 1))
    z = F.lit(float(some.agg(F.sum(F.pow(F.col("tokens") / total, F.lit(a)))).first()[0] or 1.0))
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / total, F.lit(a)) / z)
    quota = F.floor(F.round(weight * total * F.lit(budget_share), 3)).cast("long")
    sources = sources.withColumn("weight", weight).withColumn("quota", F.coalesce(quota, F.lit(0)))
    sources = sources.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens")).cast("long")).otherwise(F.lit(0).cast("long")))
    sources = sources.withColumn("rest", F.col("quota") - F.col("passes") * F.col("tokens")).withColumn("blocks", F.ceil(F.col("n_docs") / BLOCK_DOCS).cast("long"))
    sources = materialise(sources, "weights")
    order = F.md5(F.concat_ws("|", F.lit(seed), "source", F.coalesce(F.col("id").cast("string"), F.lit(""))))
    # a left row meets one source; AQE splits hot sources, as both sides of the join are shuffled unless the table of sources is small by its measured size
    placed = light.withColumn("order", order).join(sources.select("source", "weight", "quota", "tokens", "passes", "rest", "blocks"), "source")
    placed = placed.withColumn("block", F.pmod(F.conv(F.substring("order", 1, 8), 16, 10).cast("long"), F.col("blocks")))
    key = ["source", "block"]
    sums = light.withColumn("order", order).join(sources.select("source", "blocks"), "source").withColumn("block", F.pmod(F.conv(F.substring("order", 1, 8), 16, 10).cast("long"), F.col("blocks")))
    sums = sums.groupBy(*key).agg(F.sum("n_tokens").alias("held"))
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(*key, "before")
    within = Window.partitionBy(*key).orderBy("order", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(sums, key)
    start = (F.col("before") + F.col("inside")).cast("long")
    placed = placed.withColumn("start", start)
    copies = F.when(F.col("n_tokens") == 0, F.lit(1).cast("long")).otherwise(F.col("passes") + (F.col("start") + F.col("n_tokens") <= F.col("rest")).cast("long"))
    repeats = F.when(F.col("tokens") > 0, F.col("quota") / F.col("tokens"))
    return placed.select(F.col("id").alias(id_col), "source", "n_tokens", "weight", repeats.alias("repeats"), copies.alias("copies"), "block", "start", *carry)


def realise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents: each row as often as planned, with the columns of ``docs``. The planned columns travel under names that clash with none."""
    packed = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    names = docs.columns
    held = docs.select(F.col(id_col), F.col(text_col), F.col(source_col), packed.alias("_row"))
    planned = plan(held, id_col, text_col, source_col, carry=("_row",), **options)
    spread = planned.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    return spread.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(names)])
