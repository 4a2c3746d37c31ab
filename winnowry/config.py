"""Thresholds of the gates, as frozen dataclasses whose values become literals of the plan."""
from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class AcousticLimits:
    """All limits are exclusive: a clip exactly at one is kept."""

    duration_min: float = 1.5
    duration_max: float = 30.0
    rms_db_min: float = -40.0
    voiced_ratio_max: float = 0.75
    f0_cv_min: float = 0.15
    longest_voiced_max: float = 3.0


@dataclass(frozen=True)
class TranscriptLimits:
    chars_per_second: float = 12.0
    language_probability: float = 0.5
    avg_logprob: float = -1.0
    no_speech: float = 0.6
    compression: float = 2.4
    similarity: float = 0.45
    swap_below: float = 0.75
    swap_gain: float = 0.15
    least_bytes: int = 8000


@dataclass(frozen=True)
class TextLimits:
    min_script_ratio: float = 0.50
    max_latin_ratio: float = 0.45
    min_content_chars: int = 2
    allow_en: bool = True


@dataclass(frozen=True)
class Weights:
    align: float = 30.0
    asr: float = 20.0
    spk: float = 20.0
    text: float = 15.0
    src: float = 10.0
    dur: float = 5.0


@dataclass(frozen=True)
class ScorecardConfig:
    duration_min: float = 1.5
    duration_max: float = 20.0
    min_rms_db: float = -40.0
    voiced_ratio_threshold: float = 0.75
    f0_cv_threshold: float = 0.15
    longest_voiced_threshold: float = 3.0
    speaker_policy: str = "accept-or-uncertain"
    clip_min_score_lower: float = 0.25
    min_language_probability: float = 0.5
    min_avg_logprob: float = -1.0
    max_no_speech_probability: float = 0.6
    max_compression_ratio: float = 2.4
    t_align: float = 0.45
    t_align_clip: float = 0.50
    s_min: float = 60.0
    languages: tuple[str, ...] = ("zh", "ja")
    weights: Weights = field(default_factory=Weights)
    tier_src_score: tuple[tuple[str, float], ...] = (("A", 0.8), ("B", 1.0), ("C", 0.6))


@dataclass(frozen=True)
class ValidationLimits:
    fail_on_shortfall: bool = True
    align_median_min: float = 0.55
    align_p10_min: float = 0.45
    speaker_p5_margin: float = 0.05
    listen_ok_rate: float = 0.85
    listen_l2_ok_rate: float = 0.85
    listen_l3_ok_rate: float = 0.75
    listen_critical_rate: float = 0.10
    listen_coverage: float = 0.95


@dataclass(frozen=True)
class ConsensusLimits:
    keep_strict: float = 0.92
    keep_soft: float = 0.85
    third_agree: float = 0.92
    min_chars: int = 2
    prefer: str = "primary"


@dataclass(frozen=True)
class CompactionLimits:
    trigger_turns: int = 12
    trigger_chars: int = 12_000
    recent_turns: int = 8
    summary_chars: int = 1_800
