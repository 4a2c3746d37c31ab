"""Corrections of transcripts by a language model: its answers in batches, taken where they say something close to the old text."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnowry.functions.similarity import accept_correction
from winnowry.functions.text import strip

ANSWER = "results ARRAY<STRUCT<index: INT, text: STRING>>"


def unfenced(content: Column) -> Column:
    """An answer without the code fence around it: what stands between the first line and the last fence."""
    said = strip(content)
    inner = F.regexp_extract(said, r"(?s)^```[^\n]*\n(.*)```", 1)
    return F.when(said.startswith("```"), F.coalesce(F.nullif(inner, F.lit("")), F.regexp_replace(said, r"^```[^\n]*\n", ""))).otherwise(said)


def results(content: Column) -> Column:
    """Index to text of an answer; null where it isn't JSON of the expected form. Of equal indexes the last counts."""
    items = F.from_json(unfenced(content), ANSWER)["results"]
    kept = F.filter(items, lambda r: r["index"].isNotNull())
    return F.aggregate(kept, F.expr("CAST(map() AS MAP<INT, STRING>)"), lambda m, r: F.map_concat(F.map_filter(m, lambda k, v: k != r["index"]), F.create_map(r["index"], r["text"])))


def apply_answers(rows: DataFrame, answers: DataFrame, least: float = 0.72) -> DataFrame:
    """rows (batch, place, text, ...) with answers (batch, content): adds ``corrected``. A text that the answer leaves out, and all of a batch without a valid answer, stay as they are."""
    told = answers.select("batch", results(F.col("content")).alias("_new"))
    met = rows.join(told, "batch", "left").withColumn("_text", F.coalesce(F.element_at("_new", F.col("place").cast("int")), F.col("text")))
    return met.withColumn("corrected", accept_correction(F.col("text"), F.col("_text"), least)).drop("_new", "_text")
