"""Speaker scoring on unit vectors: centroids per source, cross-source similarity, calibration, bootstrap decisions."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnowry.functions.numeric import dot, l2_normalise, three_way
from winnowry.operators.windows import in_order
from winnowry.sources.scratch import written

SEED, RESAMPLES = 20260803, 128
#: Vectors of a block, on either side, and blocks a side at least when all vectors meet.
BLOCK, LEAST_BLOCKS = 16384, 4


def centroids(vectors: DataFrame, source: str = "source", vector: str = "vector") -> DataFrame:
    """(source, n, centroid): the unit vector along each source's mean. Components are averaged by a combining aggregate, so a source of any size is reduced where it's read."""
    parts = vectors.select(source, F.posexplode(vector).alias("i", "x")).groupBy(source, "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy(source).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c"))
    return whole.select(source, "n", l2_normalise(F.transform("c", lambda s: s["x"])).alias("centroid"))


def against_centroids(vectors: DataFrame, centres: DataFrame, key: str = "key", source: str = "source", vector: str = "vector", broadcast: bool = False) -> DataFrame:
    """(key, source, other, score): each vector against the centroids of all other sources. The number of sources is the caller's to check before it asks for a broadcast."""
    other = centres.select(F.col(source).alias("other"), "centroid")
    return vectors.join(F.broadcast(other) if broadcast else other, F.col(source) != F.col("other")).select(key, source, "other", dot(F.col(vector), F.col("centroid")).alias("score"))


#: Centroids are sent to the executors as one matrix up to this many bytes; more are joined.
MAX_MATRIX_BYTES = 64 << 20


def median_against_centroids(vectors: DataFrame, centres: DataFrame, key: str = "key", source: str = "source", vector: str = "vector", matrix_bytes: int = MAX_MATRIX_BYTES) -> DataFrame:
    """(key, score): the median of each vector's similarities to the centroids of other sources. Centroids of a measured size go to the tasks as a matrix, and
    a vector's scores never leave its task; otherwise pairs are joined. Rows that can't be scored are left out either way: without a source, with
    no other source, and with a vector that is null, holds null or differs in length."""
    n, size = centres.agg(F.count(F.lit(1)), F.max(F.size("centroid"))).first()
    if not n or 8 * n * size > matrix_bytes:
        return median_over_sources(against_centroids(vectors, centres, key, source, vector).where("score is not null"), key)
    rows = centres.select(source, "centroid").orderBy(source).collect()
    names, matrix = pa.array([r[0] for r in rows]), np.array([r["centroid"] for r in rows], float)
    kind = dict(vectors.dtypes)[key]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pc.index_in(batch.column(1), value_set=names)
            place = own.fill_null(-1).to_numpy(zero_copy_only=False)
            score = np.full(batch.num_rows, np.nan)
            for at, v in _by_length(batch.column(2)).values():
                if v.shape[1] == matrix.shape[1]:
                    each = v @ matrix.T
                    mine = place[at]
                    each[np.flatnonzero(mine >= 0), mine[mine >= 0]] = np.nan
                    if each.shape[1] > 1:
                        score[at] = np.nanmedian(each, axis=1)
            known = ~np.isnan(score) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["key", "score"]).filter(pa.array(known))

    out = vectors.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(vector).cast("array<double>").alias("vector")).mapInArrow(go, f"key {kind}, score double")
    return out.withColumnRenamed("key", key)


def median_over_sources(scores: DataFrame, key: str = "key") -> DataFrame:
    return scores.groupBy(key).agg(F.percentile("score", F.lit(0.5)).alias("score"))


def cross_source(vectors: DataFrame, key: str = "key", source: str = "source", vector: str = "vector") -> DataFrame:
    """(key, score): for each vector its largest similarity to each other source's candidates, then the median over sources.
    Meant for calibration candidates, a bounded number per source; the pairs are reduced to a maximum as they're made."""
    other = vectors.select(F.col(source).alias("other"), F.col(vector).alias("v"))
    pairs = vectors.join(other, F.col(source) != F.col("other")).select(key, "other", dot(F.col(vector), F.col("v")).alias("score"))
    return median_over_sources(pairs.groupBy(key, "other").agg(F.max("score").alias("score")), key)


def _by_length(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length; vectors that are null or hold null are left out."""
    length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = vectors.is_valid().to_numpy(zero_copy_only=False).copy()
    flat, parent = vectors.flatten(), pc.list_parent_indices(vectors).to_numpy(zero_copy_only=False)
    whole[parent[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    values, begin = flat.to_numpy(zero_copy_only=False).astype(float), np.cumsum(length) - length
    out = {}
    for k in np.unique(length[whole]).tolist():
        rows = np.flatnonzero(whole & (length == k))
        out[k] = rows, values[begin[rows][:, None] + np.arange(k)]
    return out


def cross_source_all(vectors: DataFrame, key: str = "key", source: str = "source", vector: str = "vector", block: int = BLOCK) -> DataFrame:
    """What ``cross_source`` gives, for whole tables: every vector meets all vectors of other sources. A task has a block of vectors and some
    sources (or a piece of a large one), and returns a maximum per vector and source. Rows without a source meet none; vectors that
    are null, hold null or differ in length have no similarity."""
    rows = vectors.where(F.col(source).isNotNull()).select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(vector).cast("array<double>").alias("vector"))
    total = rows.count()
    many = max(LEAST_BLOCKS, -(-total // block))
    sizes = rows.groupBy("source").agg(F.ceil(F.count(F.lit(1)) * F.lit(many) / F.lit(max(total, 1))).cast("int").alias("pieces")).withColumn("g", F.pmod(F.xxhash64("source"), F.lit(many)).cast("int"))
    groups = sizes.groupBy("g").agg(F.max("pieces").alias("pieces")).select("g", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("p"))
    left = rows.withColumn("i", F.pmod(F.xxhash64("key"), F.lit(many)).cast("int")).crossJoin(F.broadcast(groups))
    right = rows.join(sizes, "source").withColumn("p", F.pmod(F.xxhash64("key", F.lit("p")), F.col("pieces")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    types = dict(rows.dtypes)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            ours, theirs = _by_length(a["vector"].combine_chunks()), b["vector"].combine_chunks()
            for other in pc.unique(b["source"]):
                apart = pc.not_equal(a["source"], other).to_numpy()
                best, known = np.full(a.num_rows, -np.inf), np.zeros(a.num_rows, bool)
                for k, (_, v) in _by_length(theirs.filter(pc.equal(b["source"], other).combine_chunks())).items():
                    at, u = ours.get(k, (np.zeros(0, np.int64), None))
                    for low in range(0, len(at), 512):
                        best[at[low : low + 512]] = (u[low : low + 512] @ v.T).max(1)
                    known[at] = True
                some = np.flatnonzero(apart)
                out.append(pa.table({"key": a["key"].take(pa.array(some)), "other": pa.repeat(other, len(some)), "score": pa.array(best[some], mask=~known[some])}))
        return pa.concat_tables(out) if out else pa.table({"key": a["key"].slice(0, 0), "other": a["source"].slice(0, 0), "score": pa.array([], pa.float64())})

    met = left.select("i", "g", "p", "key", "source", "vector").groupBy("i", "g", "p").cogroup(right.select("i", "g", "p", "source", "vector").toDF("i2", "g2", "p2", "source", "vector").groupBy("i2", "g2", "p2"))
    scores = met.applyInArrow(meet, f"key {types['key']}, other {types['source']}, score double")
    best = median_over_sources(scores.groupBy("key", "other").agg(F.max("score").alias("score")), "key")
    return best.withColumnRenamed("key", key)


def candidates(records: DataFrame, per_source: int = 40) -> DataFrame:
    """The first records of each source by start offset, then key."""
    order = Window.partitionBy("source").orderBy("start", "key")
    return records.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= per_source).drop("_rn")


def _top(scored: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("source").orderBy(F.desc("score"), F.asc("key"))
    return scored.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def calibrate(vectors: DataFrame, references: int = 8) -> tuple[DataFrame, DataFrame]:
    """Calibration of bounded candidates (key, source, vector): the centroids of refined references, and one row of thresholds."""
    cross = cross_source(vectors)
    first = _top(vectors.join(cross, "key"), max(2 * references, 8))
    refined = median_against_centroids(vectors, centroids(first))
    chosen = _top(vectors.join(refined, "key"), references)
    centres = centroids(chosen)
    sums = centres.select(F.posexplode("centroid").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("k"))
    total = sums.agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("t"), F.max("k").alias("k")).select(F.transform("t", lambda a: a["s"]).alias("total"), "k")
    rest = centres.crossJoin(total).select("source", l2_normalise(F.zip_with("total", "centroid", lambda a, b: a - b)).alias("others"))
    positive = chosen.join(rest, "source").select(dot(F.col("vector"), F.col("others")).alias("p"))
    unused = vectors.join(chosen.select("key"), "key", "left_anti").join(cross, "key")
    low = unused.withColumn("_rn", F.row_number().over(Window.orderBy("score", "key"))).crossJoin(unused.agg(F.count(F.lit(1)).alias("n")))
    low = low.where(F.col("_rn") <= F.greatest(F.lit(8), F.floor(F.col("n") / 5)))
    negative = low.crossJoin(total.select(l2_normalise(F.col("total")).alias("g"))).select(dot(F.col("vector"), F.col("g")).alias("q"))
    limits = positive.agg((F.percentile("p", F.lit(0.05)) - 0.02).alias("accept")).crossJoin(negative.agg(F.coalesce(F.percentile("q", F.lit(0.99)), F.lit(-1.0)).alias("reject")))
    return centres, limits.withColumn("reject_enabled", F.col("reject") + 0.03 < F.col("accept"))


def bootstrap_means(centres: DataFrame, seed: int = SEED, resamples: int = RESAMPLES) -> DataFrame:
    """(resample, mean): the unit vector along the mean of as many centroids as there are, drawn with replacement. Draw j of resample r is the centroid, in the order of sources,
    whose place is the first 32 bits of md5(seed|r|j) modulo their number: the same on any engine. What a centroid adds is counted before it's multiplied."""
    placed = in_order(centres, F.asc("source")).select((F.col("_place") - 1).alias("place"), "centroid")
    n = placed.count()
    draws = centres.sparkSession.range(resamples * n).select(F.floor(F.col("id") / max(n, 1)).alias("resample"), (F.col("id") % max(n, 1)).alias("j"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "resample", "j")), 1, 8), 16, 10).cast("long") % max(n, 1)
    times = draws.groupBy("resample", drawn.alias("place")).agg(F.count(F.lit(1)).alias("times"))
    parts = times.join(placed, "place").select("resample", "times", F.posexplode("centroid").alias("i", "x")).groupBy("resample", "i").agg((F.sum(F.col("times") * F.col("x")) / max(n, 1)).alias("x"))
    whole = parts.groupBy("resample").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("m"))
    return whole.select("resample", l2_normalise(F.transform("m", lambda s: s["x"])).alias("mean"))


def source_scores(vectors: DataFrame, centres: DataFrame, matrix_bytes: int = MAX_MATRIX_BYTES) -> DataFrame:
    """(key, score, source_scores): a vector's similarity to each source's centroid, and their median. Centroids of a measured size go to the tasks as a matrix; more are
    joined, which gives rows as many as the scores asked for."""
    n, size = centres.agg(F.count(F.lit(1)), F.max(F.size("centroid"))).first()
    kind = dict(vectors.dtypes)["key"]
    if n and 8 * n * size > matrix_bytes:
        each = vectors.crossJoin(centres.select("source", "centroid").withColumnRenamed("source", "other")).select("key", F.col("other").cast("string").alias("other"), dot(F.col("vector"), F.col("centroid")).alias("x"))
        return each.groupBy("key").agg(F.percentile("x", F.lit(0.5)).alias("score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("other", "x")))).alias("source_scores"))
    rows = centres.orderBy("source").collect()
    names, matrix = [str(r["source"]) for r in rows], np.array([r["centroid"] for r in rows], float)

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not pdf.empty:
                each = np.stack(pdf["vector"].to_numpy()).astype(float) @ matrix.T
                yield pd.DataFrame({"key": pdf["key"], "score": np.median(each, axis=1), "source_scores": [dict(zip(names, x.tolist(), strict=True)) for x in each]})

    return vectors.select("key", "vector").mapInPandas(go, f"key {kind}, score double, source_scores map<string,double>")


def decide(vectors: DataFrame, centres: DataFrame, limits: DataFrame, seed: int = SEED, resamples: int = RESAMPLES) -> DataFrame:
    """(key, decision, score, score_lower, score_upper, source_scores): the median over sources, a bootstrap interval of the mean centroid, and the decision it allows. The resampled
    means, as many as ``resamples``, go to the tasks. Vectors (unique keys) are unit vectors of the centroids' length."""
    centres, limits = written(centres, "centres"), written(limits, "limits")  # calibration is done once
    means = np.array([r["mean"] for r in bootstrap_means(centres, seed, resamples).orderBy("resample").collect()], float)
    kind = dict(vectors.dtypes)["key"]

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not pdf.empty:
                boot = np.stack(pdf["vector"].to_numpy()).astype(float) @ means.T
                yield pd.DataFrame({"key": pdf["key"], "score_lower": np.percentile(boot, 5, axis=1), "score_upper": np.percentile(boot, 95, axis=1)})

    bounds = vectors.select("key", "vector").mapInPandas(go, f"key {kind}, score_lower double, score_upper double")
    rows = source_scores(vectors, centres).join(bounds, "key").crossJoin(F.broadcast(limits.select("accept", "reject", "reject_enabled")))
    decision = three_way(F.col("score_lower"), F.col("score_upper"), F.col("accept"), F.col("reject"), F.col("reject_enabled"))
    return rows.select("key", decision.alias("decision"), "score", "score_lower", "score_upper", "source_scores")
