"""Checks V1 to V8 of a selected dataset, listening samples and their evaluation."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnowry.config import ScorecardConfig, TextLimits, ValidationLimits
from winnowry.functions import text as T
from winnowry.operators.selection import bottom_share, stratified

CRITICAL = ("非本人", "文不对题")
LAYERS = {"L1": 0.25, "L2": 0.25, "L3": 0.20, "L4": 0.15, "L5": 0.15}


def source_caps(rows: DataFrame, share: float, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, n, sources, most, over): rows and sources of each language, the most rows of one source, and whether those are over its share."""
    each = rows.groupBy(F.col(lang).alias("lang"), F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("k"))
    caps = each.groupBy("lang").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("sources"), F.max("k").alias("most"))
    return caps.withColumn("over", F.col("most") > F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("n"))))


def validate(manifest: DataFrame, stats: DataFrame, scores: DataFrame, annotation: DataFrame, files: DataFrame, ratio: float, share: float, limits: ValidationLimits | None = None, cfg: ScorecardConfig | None = None, languages: tuple[str, str] = ("zh", "ja"), tags: tuple[str, ...] = ("ZH", "JP")) -> DataFrame:
    """(id, pass, detail), a row per check. manifest and scores are keyed by path; stats is the selection's one row."""
    v, c = limits or ValidationLimits(), cfg or ScorecardConfig()
    check = lambda rows, id, ok, detail: rows.select(F.lit(id).alias("id"), ok.alias("pass"), detail.alias("detail"))
    said = lambda **x: F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), F.coalesce(e.cast("string"), F.lit("-"))) for k, e in x.items()])
    share_now = F.coalesce(F.try_divide(F.col("n_primary"), F.col("n_total")), F.lit(0.0))
    met = manifest.select("path", "lang", "text", "source_id").join(scores.select("path", F.col("decision").alias("d"), F.col("score").alias("s"), F.col("metrics.similarity").alias("sim"), F.col("metrics.score_lower").alias("low"), F.lit(True).alias("known")), "path", "left")
    bad = met.agg(F.count_if(F.col("known").isNull() | (F.col("d") != "candidate") | (F.coalesce("s", F.lit(0.0)) < c.s_min)).alias("bad"))
    sims = met.agg(F.count("sim").alias("n"), F.percentile("sim", F.lit(0.5)).alias("median"), F.percentile("sim", F.lit(0.1)).alias("p10"))
    lows = met.agg(F.percentile("low", F.lit(0.05)).alias("chosen")).crossJoin(scores.where("decision = 'candidate'").agg(F.percentile("metrics.score_lower", F.lit(0.05)).alias("pool")))
    code = T.normalize_lang(F.col("lang"))
    per_source = manifest.select(code.alias("lang"), F.coalesce("source_id", F.lit("")).alias("source")).where(F.col("lang").isin(*languages))
    over = source_caps(per_source, share).agg(F.count_if("over").alias("over"))
    texts = manifest.select(T.text_key(F.col("text")).alias("key"), (F.size(T.quality_reasons(F.col("text"), code, TextLimits(allow_en="en" in languages))) > 0).alias("poor"))
    keys = texts.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.count_if("poor").alias("poor")).agg(F.coalesce(F.sum("poor"), F.lit(0)).alias("poor"), F.count_if(F.col("k") > 1).alias("twice"))
    parts = F.split("value", r"\|")
    lines = annotation.agg(F.count(F.lit(1)).alias("lines"), F.count_if((F.size(parts) < 4) | ~F.coalesce(F.get(parts, F.lit(2)).isin(*tags), F.lit(False))).alias("malformed"))
    sizes = lines.crossJoin(files.agg(F.count(F.lit(1)).alias("files"))).crossJoin(manifest.agg(F.count(F.lit(1)).alias("rows")))
    return reduce(DataFrame.unionByName, [
        check(stats, "V1", ~(F.col("shortfall") & F.lit(v.fail_on_shortfall)), said(n_total=F.col("n_total"), shortfall=F.col("shortfall"))),
        check(stats, "V2", (F.col("n_total") > 0) & (share_now >= ratio - 1e-9), said(ratio=F.round(share_now, 4))),
        check(bad, "V3", F.col("bad") == 0, said(bad=F.col("bad"))),
        check(sims, "V4", F.coalesce((F.col("median") >= v.align_median_min) & (F.col("p10") >= v.align_p10_min), F.col("n") == 0), said(median=F.round("median", 6), p10=F.round("p10", 6))),
        check(lows, "V5", F.coalesce(F.col("chosen") >= F.col("pool") - v.speaker_p5_margin, F.lit(True)), said(chosen=F.round("chosen", 6), pool=F.round("pool", 6))),
        check(over, "V6", F.col("over") == 0, said(over=F.col("over"))),
        check(keys, "V7", (F.col("poor") == 0) & (F.col("twice") == 0), said(poor=F.col("poor"), twice=F.col("twice"))),
        check(sizes, "V8", (F.col("lines") == F.col("files")) & (F.col("lines") == F.col("rows")) & (F.col("malformed") == 0), said(lines=F.col("lines"), files=F.col("files"), rows=F.col("rows"))),
    ])


def listen_sample(manifest: DataFrame, scores: DataFrame, n: int, seed: int | str, t_align: float = 0.45, primary: str = "zh", secondary: str = "ja") -> DataFrame:
    """A stratified sample for listening: (id, layer, path, text, lang, tier, score, label). Layers overlap and are filled in order, each without what earlier ones took."""
    code = T.normalize_lang(F.col("lang"))
    met = manifest.join(scores.select("path", F.col("metrics.similarity").alias("_sim")), "path", "left")
    sizes = {k: int(n * share) for k, share in LAYERS.items()}
    sizes["L1"] += max(0, n - sum(sizes.values()))
    pools = {
        "L1": met.where((F.col("tier") == "B") & (code == primary)), "L2": met.where(F.col("tier") == "A"), "L3": met.where(F.col("_sim").between(t_align, t_align + 0.1)),
        "L4": bottom_share(met, 0.10, F.asc("score"), F.asc("path")), "L5": met.where(code == secondary),
    }
    taken = stratified([(k, pools[k], sizes[k]) for k in LAYERS], "path", seed)
    rows = taken.join(manifest.select("path", "text", "lang", "tier", "score"), "path")
    from pyspark.sql.window import Window

    number = F.row_number().over(Window.orderBy("layer", "path")) - 1  # a listening sample has a few dozen rows
    return rows.withColumn("id", F.format_string("%s_%03d", "layer", number)).select("id", "layer", "path", "text", "lang", "tier", "score", F.lit("").alias("label"))


def evaluate_listening(rows: DataFrame, limits: ValidationLimits | None = None) -> DataFrame:
    """One row: pass, ok_rate, coverage, l2_ok_rate, l3_ok_rate, worst_critical (the largest critical rate of a layer)."""
    v = limits or ValidationLimits()
    label = T.strip(F.coalesce("label", F.lit("")))
    told = rows.withColumn("_l", label)
    has, ok = F.col("_l") != "", F.col("_l") == "OK"
    layers = told.groupBy("layer").agg(F.count(F.lit(1)).alias("rows"), F.count_if(has).alias("n"), F.count_if(ok).alias("ok"), F.count_if(F.col("_l").isin(*CRITICAL)).alias("critical"))
    rate = lambda layer: F.max(F.when(F.col("layer") == layer, F.try_divide("ok", "n")))
    one = layers.agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("ok").alias("ok"), rate("L2").alias("l2_ok_rate"), rate("L3").alias("l3_ok_rate"), F.max(F.try_divide("critical", "n")).alias("worst_critical"))
    one = one.withColumns({"ok_rate": F.coalesce(F.try_divide("ok", "n"), F.lit(0.0)), "coverage": F.coalesce(F.try_divide("n", "rows"), F.lit(0.0))})
    good = (F.col("n") > 0) & (F.col("coverage") >= v.listen_coverage) & (F.col("ok_rate") >= v.listen_ok_rate)
    good = good & F.coalesce(F.col("l2_ok_rate") >= v.listen_l2_ok_rate, F.lit(True)) & F.coalesce(F.col("l3_ok_rate") >= v.listen_l3_ok_rate, F.lit(True)) & F.coalesce(F.col("worst_critical") < v.listen_critical_rate, F.lit(True))
    return one.select(F.coalesce(good, F.lit(False)).alias("pass"), "ok_rate", "coverage", "l2_ok_rate", "l3_ok_rate", "worst_critical")
