"""Quality gates. A gate is a condition with a reason; chains give the first reason, scorecards collect all."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnowry.config import AcousticLimits, ScorecardConfig, TextLimits, TranscriptLimits
from winnowry.functions import text as T
from winnowry.functions.numeric import finite, or_default

POLICIES = {"accept": ("accept",), "accept-or-uncertain": ("accept", "uncertain")}


def acoustic_reason(limits: AcousticLimits | None = None) -> Column:
    """duration, low_energy or singing; null keeps. Singing is a long voiced run, or much voice with a steady pitch."""
    c = limits or AcousticLimits()
    duration, voiced, cv = F.col("duration"), F.col("voiced_ratio"), F.col("f0_cv")
    return T.first_reason(
        ((duration < c.duration_min) | (duration > c.duration_max), "duration"),
        (F.col("rms_db") < c.rms_db_min, "low_energy"),
        (((voiced > c.voiced_ratio_max) & (cv < c.f0_cv_min)) | (F.col("longest_voiced") > c.longest_voiced_max), "singing"),
    )


def is_singing(cfg: ScorecardConfig | None = None) -> Column:
    """The scorecard's rule: all three measures together, or the recorded reason where a measure is missing."""
    c = cfg or ScorecardConfig()
    voiced, cv, longest = (finite(F.col(x)) for x in ("voiced_ratio", "f0_cv", "longest_voiced"))
    measured = voiced.isNotNull() & cv.isNotNull() & longest.isNotNull()
    all_three = (voiced > c.voiced_ratio_threshold) & (cv < c.f0_cv_threshold) & (longest > c.longest_voiced_threshold)
    return F.when(measured, all_three).otherwise(F.coalesce(F.col("reason") == "singing", F.lit(False)))


def is_derivative(files: DataFrame, stems: DataFrame | None) -> DataFrame:
    """Files whose name before the vocals marker is in the whitelist (stem); without a whitelist all files."""
    if stems is None:
        return files
    return files.withColumn("stem", T.source_stem(F.col("path"))).join(stems.select("stem").distinct(), "stem", "left_semi")


def select_slices(slices: DataFrame, filters: DataFrame, speakers: DataFrame, policy: str) -> DataFrame:
    """Slices that the filter keeps and the speaker policy allows. A slice without a filter row, or a kept one without a speaker row, is an error of the plan."""
    whole = slices.join(filters.select("path", F.col("keep").alias("_keep"), F.lit(True).alias("_f")), "path", "left")
    whole = whole.withColumn("_keep", F.when(F.col("_f").isNull(), F.raise_error(F.concat(F.lit("no filter row: "), "path")).cast("boolean")).otherwise(F.coalesce("_keep", F.lit(False)))).where("_keep")
    whole = whole.join(speakers.select("path", F.col("decision").alias("_d"), F.lit(True).alias("_s")), "path", "left")
    decision = F.when(F.col("_s").isNull(), F.raise_error(F.concat(F.lit("no speaker row: "), "path")).cast("string")).otherwise(F.col("_d"))
    return whole.where(decision.isin(*POLICIES[policy])).select(*slices.columns)


def swapped_text(limits: TranscriptLimits | None = None) -> Column:
    """The forced transcript where similarity is middling and it's clearly more in the language's script and of quality; else the text."""
    c = limits or TranscriptLimits()
    better = T.script_ratio(F.col("forced_text"), F.col("lang")) > T.script_ratio(F.col("text"), F.col("lang")) + c.swap_gain
    good = F.size(T.quality_reasons(F.col("forced_text"), F.col("lang"))) == 0
    forced = F.col("similarity").between(c.similarity, c.swap_below) & (F.col("similarity") < c.swap_below) & better & good
    return F.when(F.coalesce(forced, F.lit(False)), F.col("forced_text")).otherwise(F.col("text"))


def transcript_gates(text: Column, limits: TranscriptLimits | None = None) -> list[tuple[Column, str]]:
    """Gates on a transcript's confidence; they hold only for rows measured by version 1 with a duration. A missing log probability fails, other missing measures pass."""
    c = limits or TranscriptLimits()
    measured = (F.col("asr_quality_version") == 1) & (F.col("audio_duration") > 0)
    return [
        (measured & (F.length(T.no_space(text)) / F.when(F.col("audio_duration") > 0, F.col("audio_duration")) > c.chars_per_second), "text_density"),
        (measured & (F.col("language_probability") < c.language_probability), "language_confidence"),
        (measured & (F.col("avg_logprob").isNull() | (F.col("avg_logprob") < c.avg_logprob)), "asr_logprob"),
        (measured & (F.col("max_no_speech_probability") > c.no_speech), "asr_no_speech"),
        (measured & (F.col("max_compression_ratio") > c.compression), "asr_compression"),
    ]


def cascade(rows: DataFrame, policy: str = "accept-or-uncertain", text_limits: TextLimits | None = None, limits: TranscriptLimits | None = None) -> DataFrame:
    """The dataset's chain of gates over joined rows: adds ``reason`` (the first gate that fails; null keeps) and ``final_text``.

    Columns read: path, lang, text, whitelisted, filter_keep, decision, align_keep, align_reason, similarity, forced_text,
    aligned (whether there's an alignment row), the transcript's measures, file_size (null: no file)."""
    c = limits or TranscriptLimits()
    code = T.normalize_lang(F.col("lang"))
    quality = F.get(T.quality_reasons(F.col("text"), F.col("lang"), text_limits), F.lit(0))
    final = swapped_text(c)
    decision = F.coalesce("decision", F.lit("missing"))
    reason = T.first_reason(
        (F.coalesce("path", F.lit("")) == "", "missing_path"),
        (~F.col("whitelisted"), "source_whitelist"),
        (~F.col("filter_keep").eqNullSafe(F.lit(True)), "audio_filter"),
        (~decision.isin(*POLICIES[policy]), F.concat(F.lit("speaker_"), decision)),
        (~code.isin("ja", "zh", "en"), "language"),
        (F.length(T.strip(F.coalesce("text", F.lit("")))) < 2, "short_text"),
        (quality.isNotNull(), F.concat(F.lit("text_"), quality)),
        (~F.col("aligned"), "alignment_missing"),
        (F.col("align_keep").eqNullSafe(F.lit(False)), F.concat(F.lit("alignment_"), F.coalesce("align_reason", F.lit("rejected")))),
        (F.col("similarity") < c.similarity, "alignment_low_sim"),
        *transcript_gates(final, c),
        (F.col("file_size").isNull(), "missing_audio"),
        (F.col("file_size") < c.least_bytes, "tiny_audio"),
    )
    return rows.withColumn("final_text", F.replace(final, F.lit("|"), F.lit("/"))).withColumn("reason", reason)


def candidates_for_alignment(rows: DataFrame, policy: str = "accept-or-uncertain") -> DataFrame:
    """Rows worth a second transcription: those that pass all gates that need none."""
    decision_ok = F.coalesce("decision", F.lit("missing")).isin(*POLICIES[policy])
    return rows.where(F.col("filter_keep").eqNullSafe(F.lit(True)) & decision_ok & (F.size(T.quality_reasons(F.col("text"), F.col("lang"))) == 0))


def alignment_verdict(limits: TranscriptLimits | None = None) -> Column:
    """empty_forced, forced_text_*, low_similarity, forced_logprob or forced_no_speech; null keeps."""
    c = limits or TranscriptLimits()
    quality = F.get(T.quality_reasons(F.col("forced_text"), F.col("lang")), F.lit(0))
    return T.first_reason(
        (F.length(T.strip(F.coalesce("forced_text", F.lit("")))) == 0, "empty_forced"),
        (quality.isNotNull(), F.concat(F.lit("forced_text_"), quality)),
        (F.col("similarity") < c.similarity, "low_similarity"),
        (F.col("avg_logprob") < c.avg_logprob, "forced_logprob"),
        (F.col("max_no_speech_probability") > c.no_speech, "forced_no_speech"),
    )


def meets_confidence() -> Column:
    """The review pool's test; a measure of 0 counts as missing."""
    return (
        (F.col("segment_count").isNull() | (F.col("segment_count") == 1))
        & (or_default(F.col("avg_logprob"), -99.0) >= -0.2)
        & (or_default(F.col("language_probability"), 0.0) >= 0.9)
        & (or_default(F.col("max_no_speech_probability"), 0.0) <= 0.3)
        & (or_default(F.col("max_compression_ratio"), 99.0) <= 1.2)
        & (F.size(T.quality_reasons(F.col("text"), F.col("lang"))) == 0)
    )


#: Limits of the clip analysis (fixed values). A log probability above its limit is a reason, as specified, though higher is better.
CLIP = {"phonemes": (12, 60), "duration": (2.5, 10.0), "logprob": {"zh": -0.45, "ja": -0.30}, "truncated": {"zh": 8, "ja": 12}, "lang_prob": 0.70, "asr": 0.50}


def clip_reasons(lang: str) -> Column:
    """All reasons against a clip: columns text, phones, duration, avg_logprob, language_probability, comp_asr."""
    low, high = CLIP["phonemes"]
    n = F.when(T.strip(F.coalesce("phones", F.lit(""))) == "", 0).otherwise(F.size(F.split(T.strip(F.col("phones")), r"(?U)\s+")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    limit = CLIP["logprob"][lang]
    quality = F.transform(T.quality_reasons(F.col("text"), F.lit(lang)), lambda r: F.concat(F.lit("text:"), r))
    return F.concat(quality, T.reasons(
        ((n > 0) & (n < low), f"phoneme_lt{low}"), ((n > 0) & (n > high), f"phoneme_gt{high}"),
        (~zero("duration").between(*CLIP["duration"]), "duration_out_of_range"),
        (zero("avg_logprob") > limit, f"logprob_gt{-limit}"),
        (zero("language_probability") < CLIP["lang_prob"], "lang_prob_low"),
        (zero("comp_asr") < CLIP["asr"], "asr_comp_low"),
        (T.is_truncated(F.col("text"), CLIP["truncated"][lang]), "truncated_short"),
    ))


def mid_band(report: DataFrame, annotation: DataFrame, low: float = 0.60, high: float = 0.85) -> DataFrame:
    return report.where((F.col("similarity") >= low) & (F.col("similarity") < high)).join(annotation.select("name").distinct(), "name", "left_semi")


def part_state() -> Column:
    """missing, invalid, complete or resumable, from metadata: present, size, total_size, expected, decoded (durations), clean."""
    size, total, expected, decoded, clean = (F.col(c) for c in ("size", "total_size", "expected", "decoded", "clean"))
    ratio = F.when(expected > 0, decoded / F.when(expected > 0, expected)).otherwise(0.0)
    return (
        F.when(~F.col("present"), "missing")
        .when(size <= 0, "invalid")
        .when((total > 0) & (size > total), "invalid")
        .when((expected > 0) & (ratio > 1.02), "invalid")
        .when((expected > 0) & clean & (ratio >= 0.98), "complete")
        .when((expected <= 0) & clean & (total > 0) & (size == total), "complete")
        .when((total > 0) & (size == total), "invalid")
        .when((total > 0) & (expected > 0) & (size / F.when(total > 0, total) > 0.05) & (ratio + 0.08 < size / F.when(total > 0, total)), "invalid")
        .when((total <= 0) & ~clean, "invalid")
        .when(~clean & (decoded <= 0), "invalid")
        .otherwise("resumable")
    )


def asset_status() -> Column:
    """Status of an asset after two left joins: raw_path, wav_path, probe_error, expected, raw_duration, wav_duration."""
    return (
        F.when(F.col("raw_path").isNull(), "missing_raw")
        .when(F.col("wav_path").isNull(), "missing_wav")
        .when(F.col("probe_error"), "probe_error")
        .when(F.coalesce("expected", F.lit(0.0)) <= 0, "unchecked")
        .when(F.col("raw_duration") < 0.98 * F.col("expected"), "truncated_raw")
        .when(F.abs(F.col("wav_duration") - F.col("raw_duration")) > 0.02 * F.col("raw_duration"), "wav_mismatch")
        .otherwise("ready")
    )


def incomplete_outputs(sources: DataFrame, outputs: DataFrame, share: float = 0.98) -> DataFrame:
    """Sources (stem, duration) whose longest output (stem, duration) is shorter than ``share`` of theirs, or that have none."""
    longest = outputs.groupBy("stem").agg(F.max("duration").alias("longest"))
    return sources.join(longest, "stem", "left").where(F.coalesce("longest", F.lit(0.0)) < share * F.col("duration"))


def valid_requests(rows: DataFrame) -> DataFrame:
    """Chat requests with ``error`` (null: valid): text not blank and at most 2000 characters, session id of up to 64 safe characters."""
    text = T.strip(F.coalesce("text", F.lit("")))
    return rows.withColumn("error", T.first_reason((text == "", "empty_text"), (F.length(text) > 2000, "text_too_long"), (~F.coalesce("session_id", F.lit("")).rlike("^[A-Za-z0-9_-]{1,64}$"), "bad_session")))
