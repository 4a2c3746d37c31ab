"""Consensus of transcripts: similarity first (one pass of pandas functions), then decisions as plain expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnowry.config import ConsensusLimits, TextLimits
from winnowry.functions import text as T
from winnowry.functions.similarity import char_error_rate, similarity


def pick_text(a: Column, b: Column, logprob_a: Column, logprob_b: Column, prefer: str = "primary") -> Column:
    """struct(text, source) of two transcripts that agree: the one that isn't empty, the much longer one, the surer one, the preferred one."""
    n_a, n_b = F.length(T.compact_text(a)), F.length(T.compact_text(b))
    one = lambda text, source: F.struct(text.alias("text"), F.lit(source).alias("source"))
    return (
        F.when((n_a == 0) & (n_b > 0), one(b, "secondary"))
        .when(n_b == 0, one(a, "primary"))
        .when((n_a >= n_b * 1.25) & (n_a - n_b >= 3), one(a, "primary_longer"))
        .when((n_b >= n_a * 1.25) & (n_b - n_a >= 3), one(b, "secondary_longer"))
        .when(logprob_a > logprob_b + 0.05, one(a, "primary_logprob"))
        .when(logprob_b > logprob_a + 0.05, one(b, "secondary_logprob"))
        .otherwise(one(b, "secondary") if prefer == "secondary" else one(a, "primary"))
    )


def adjudicate(rows: DataFrame, limits: ConsensusLimits | None = None) -> DataFrame:
    """rows: primary, secondary, third (null: none), primary_logprob, secondary_logprob. Adds decision, tier, final_text, sim_ab, sim_ac, sim_bc, cer_ab, chosen.
    Similarities are computed only where both transcripts say something."""
    c = limits or ConsensusLimits()
    rows = rows.withColumns({x: T.strip(F.coalesce(x, F.lit(""))) for x in ("primary", "secondary")}).withColumn("third", T.strip(F.col("third")))
    n_a, n_b = F.length(T.compact_text(F.col("primary"))), F.length(T.compact_text(F.col("secondary")))
    rows = rows.withColumns({"_a": n_a, "_b": n_b})
    none, one = (F.col("_a") == 0) & (F.col("_b") == 0), (F.col("_a") == 0) | (F.col("_b") == 0)
    # null arguments return at once, so rows without a pair cost no comparison
    pair = lambda x: F.when(~one, F.col(x))
    rows = rows.withColumns({"sim_ab": similarity(pair("primary"), pair("secondary")), "cer_ab": char_error_rate(pair("primary"), pair("secondary"))})
    third = F.col("third").isNotNull() & ~one
    rows = rows.withColumns({"sim_ac": similarity(F.when(third, F.col("primary")), F.when(third, F.col("third"))), "sim_bc": similarity(F.when(third, F.col("secondary")), F.when(third, F.col("third")))})
    rows = rows.withColumns({"sim_ab": F.when(none, None).when(one, 0.0).otherwise(F.col("sim_ab")), "cer_ab": F.when(~one, F.col("cer_ab")), "sim_ac": F.when(third, F.col("sim_ac")), "sim_bc": F.when(third, F.col("sim_bc"))})
    soft = (F.col("sim_ab") >= c.keep_soft) & (F.col("sim_ab") < c.keep_strict) & F.col("third").isNotNull()
    tier = (
        F.when(none, "drop_empty").when(one, "drop_no_pair").when((F.col("_a") < c.min_chars) & (F.col("_b") < c.min_chars), "drop_empty")
        .when(F.col("sim_ab") >= c.keep_strict, "strict").when(soft & ((F.col("sim_ac") >= c.third_agree) | (F.col("sim_bc") >= c.third_agree)), "soft_third").otherwise("drop_low_sim")
    )
    picked = pick_text(F.col("primary"), F.col("secondary"), F.col("primary_logprob"), F.col("secondary_logprob"), c.prefer)
    by_third = F.col("sim_ac") >= c.third_agree
    rows = rows.withColumn("tier", tier).withColumn("decision", F.when(F.col("tier").isin("strict", "soft_third"), "keep").otherwise("drop"))
    text = F.when(F.col("tier") == "strict", picked["text"]).when(F.col("tier") == "soft_third", F.when(by_third, F.col("primary")).otherwise(F.col("secondary")))
    source = F.when(F.col("tier") == "strict", picked["source"]).when(F.col("tier") == "soft_third", F.when(by_third, "primary_third").otherwise("secondary_third"))
    return rows.withColumns({"final_text": text, "chosen": source}).drop("_a", "_b")


def build_consensus(joined: DataFrame, limits: ConsensusLimits | None = None) -> DataFrame:
    """Joined engine transcripts (see joins.engines: name, lang, text_1.., has_1..) to decisions; a missing engine and a kept text of poor quality are tiers of their own."""
    third = F.col("text_3") if "text_3" in joined.columns else F.lit(None).cast("string")
    rows = adjudicate(joined.withColumns({"primary": F.col("text_1"), "secondary": F.col("text_2"), "third": third, "primary_logprob": F.col("logprob_1"), "secondary_logprob": F.col("logprob_2")}), limits)
    poor = (F.col("decision") == "keep") & (F.size(T.quality_reasons(F.col("final_text"), F.col("lang"), TextLimits())) > 0)
    tier = F.when(~F.col("has_2"), "drop_no_funasr").when(~F.col("has_1"), "drop_no_whisper").when(poor, "drop_text_quality").otherwise(F.col("tier"))
    rows = rows.withColumn("tier", tier).withColumn("decision", F.when(F.col("tier").startswith("drop"), "drop").otherwise(F.col("decision")))
    return rows.withColumn("final_text", F.when(F.col("decision") == "keep", F.col("final_text")))


def third_pass(rows: DataFrame, agree: float = 0.85) -> DataFrame:
    """rows: name, text1, text2, text3 (null: none). Adds sim13, sim23, decision and text_new: the second text if it agrees with the third, else the first, else drop."""
    say = lambda x: F.length(T.compact_text(F.col(x), T.ADJUDICATION_PUNCTUATION)) > 0
    s13, s23 = F.round(similarity(F.col("text1"), F.col("text3")), 4), F.round(similarity(F.col("text2"), F.col("text3")), 4)
    rows = rows.withColumns({"sim13": F.when(F.col("text3").isNotNull(), s13), "sim23": F.when(F.col("text3").isNotNull(), s23)})
    second, first = (F.col("sim23") >= agree) & say("text2"), (F.col("sim13") >= agree) & say("text1")
    decision = F.when(F.col("text3").isNull(), "no_pass3").when(second | first, "keep").otherwise("drop")
    return rows.withColumns({"decision": decision, "text_new": F.when(F.col("text3").isNull(), None).when(second, T.to_simplified(F.col("text2"))).when(first, F.col("text1"))})
