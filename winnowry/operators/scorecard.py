"""The scorecard: a full outer join of the stage tables, hard gates, soft components and a weighted score."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnowry.config import ScorecardConfig, TextLimits
from winnowry.functions import text as T
from winnowry.functions.numeric import clamp, finite, weighted_mean
from winnowry.operators.gates import POLICIES, is_singing


def union_of_stages(filters: DataFrame, speakers: DataFrame, asr: DataFrame, align: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per path that any stage knows: structs f, s, a, g (null where a stage lacks it), and tier and risks of its
    source's plan ('C' and none by default). The joins shuffle each stage once on the path; the plan, a table of
    recordings, is joined by its measured size."""
    sides = [rows.select("path", F.struct(*[c for c in rows.columns if c != "path"]).alias(name)) for rows, name in ((asr, "a"), (align, "g"), (filters, "f"), (speakers, "s"))]
    whole = sides[0]
    for side in sides[1:]:
        whole = whole.join(side, "path", "full_outer")
    told = plan.select("source_id", "tier", F.col("risk").alias("risks")).dropDuplicates(["source_id"])
    whole = whole.withColumn("source_id", T.source_id(F.col("path"))).join(told, "source_id", "left")
    return whole.withColumns({"tier": F.coalesce(F.nullif("tier", F.lit("")), F.lit("C")), "risks": F.coalesce("risks", F.array().cast("array<string>"))})


def soft_components(cfg: ScorecardConfig, similarity: Column, lang_prob: Column, logprob: Column, speaker: Column, measured: Column, lang: Column, tier: Column, risks: Column, duration: Column) -> dict[str, Column]:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    span = -cfg.min_avg_logprob
    scaled = clamp((logprob - F.lit(cfg.min_avg_logprob)) / F.lit(span)) if span > 0 else F.lit(0.0)
    n = measured["content"]
    content = F.when(n < 2, 0.0).when(n <= 40, 1.0).otherwise(F.greatest(F.lit(0.5), F.lit(40.0) / F.greatest(n, F.lit(1))))
    source = F.lit(0.6)
    for name, value in cfg.tier_src_score:
        source = F.when(tier == name, F.lit(value)).otherwise(source)
    low, high = cfg.duration_min, cfg.duration_max
    ramp_up = F.lit(0.5) + 0.5 * ((duration - low) / (2.0 - low) if low < 2.0 else F.lit(1.0))
    ramp_down = F.lit(1.0) - 0.5 * ((duration - 12.0) / (high - 12.0) if high > 12.0 else F.lit(0.0))
    return {
        "align": clamp(zero(similarity)),
        "asr": 0.5 * clamp(zero(lang_prob)) + 0.5 * zero(scaled),
        "spk": clamp(zero(speaker)),
        "text": clamp(T.measured_script_ratio(measured, lang) * content),
        "src": clamp(source * F.when(F.arrays_overlap(risks, F.array(F.lit("watch"), F.lit("bgm"))), 0.85).otherwise(1.0)),
        "dur": clamp(F.when(duration.isNull(), 0.0).when(duration.between(2.0, 12.0), 1.0).when((duration >= low) & (duration < 2.0), ramp_up).when((duration > 12.0) & (duration <= high), ramp_down).otherwise(0.0)),
    }


def scorecard(stages: DataFrame, cfg: ScorecardConfig | None = None) -> DataFrame:
    """The scorecard of rows from ``union_of_stages``."""
    c = cfg or ScorecardConfig()
    num = lambda name: finite(F.col(name))
    rows = stages.withColumns({
        "duration": F.coalesce(num("f.duration"), num("a.audio_duration")), "rms_db": num("f.rms_db"), "similarity": num("g.similarity"),
        "speaker_score": num("s.score"), "score_lower": num("s.score_lower"), "language_probability": num("a.language_probability"), "avg_logprob": num("a.avg_logprob"),
        "lang": T.normalize_lang(F.col("a.lang")), "need": F.when(F.col("tier") == "A", c.t_align_clip).otherwise(c.t_align),
        "voiced_ratio": F.col("f.voiced_ratio"), "f0_cv": F.col("f.f0_cv"), "longest_voiced": F.col("f.longest_voiced"), "reason": F.col("f.reason"),
    })
    forced = T.strip(F.coalesce("g.forced_text", F.lit("")))
    use_forced = F.col("g.keep").eqNullSafe(F.lit(True)) & (F.col("similarity") >= F.col("need")) & (forced != "")
    text = F.when(F.coalesce(use_forced, F.lit(False)), forced).otherwise(T.strip(F.coalesce("a.text", F.lit(""))))
    rows = rows.withColumn("text", F.when(F.col("lang") == "zh", T.to_simplified(text)).otherwise(text))
    rows = rows.withColumn("measured", T.measures(F.replace("text", F.lit("|"), F.lit("/"))))
    no_asr, no_align, lang = F.col("a").isNull(), F.col("g").isNull(), F.when(F.col("lang") == "", "zh").otherwise(F.col("lang"))
    speaker_bad = F.col("s").isNull() | ~F.coalesce("s.decision", F.lit("")).isin(*POLICIES.get(c.speaker_policy, ("accept",)))
    weak_clip = (F.col("tier") == "A") & (F.col("score_lower").isNull() | (F.col("score_lower") < c.clip_min_score_lower))
    asr_bad = (F.col("language_probability").isNull() | (F.col("language_probability") < c.min_language_probability) | F.col("avg_logprob").isNull() | (F.col("avg_logprob") < c.min_avg_logprob)
               | F.coalesce(num("a.max_no_speech_probability") > c.max_no_speech_probability, F.lit(False)) | F.coalesce(num("a.max_compression_ratio") > c.max_compression_ratio, F.lit(False)))
    quality = (F.col("text") == "") | (F.size(T.measured_reasons(F.col("measured"), lang, TextLimits(allow_en="en" in c.languages))) > 0)
    gates = T.reasons(
        (F.col("duration").isNull() | ~F.col("duration").between(c.duration_min, c.duration_max), "duration"),
        (F.col("rms_db").isNull() | (F.col("rms_db") < c.min_rms_db), "low_energy"),
        (F.col("f").isNotNull() & is_singing(c), "singing"),
        (speaker_bad | weak_clip, "speaker"),
        (no_asr, "missing_asr"),
        (~no_asr & ~F.col("lang").isin(*c.languages), "lang"),
        (no_asr | asr_bad, "asr_quality"),
        (no_align, "missing_alignment"),
        (no_align | F.col("similarity").isNull() | (F.col("similarity") < F.col("need")), "alignment"),
        (quality, "text_quality"),
    )
    parts = soft_components(c, *[F.col(x) for x in ("similarity", "language_probability", "avg_logprob", "speaker_score", "measured")], lang, F.col("tier"), F.col("risks"), F.col("duration"))
    rows = rows.withColumn("components", F.struct(*[v.alias(k) for k, v in parts.items()])).withColumn("reject_reasons", F.array_distinct(gates))
    raw = weighted_mean({k: F.col(f"components.{k}") for k in parts}, vars(c.weights))
    metrics = F.struct("duration", "similarity", "speaker_score", "score_lower", "language_probability", "avg_logprob", "rms_db")
    decision = F.when(F.size("reject_reasons") > 0, "reject").when(raw < c.s_min, "borderline").otherwise("candidate")
    return rows.select("path", "source_id", "tier", "lang", "text", decision.alias("decision"), F.round(raw, 4).alias("score"), "components", "reject_reasons", metrics.alias("metrics"), "risks")
