"""Keyed joins of stage tables with completeness checks, and set operations on keys."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnowry.functions.text import basename
from winnowry.sources.readers import engine_map


def join_stages(asr: DataFrame, filters: DataFrame | None = None, speakers: DataFrame | None = None, align: DataFrame | None = None) -> DataFrame:
    """Transcripts with their filter, speaker and alignment rows as columns; an optional table that is absent leaves its columns null."""
    rows = asr
    wanted = (
        (filters, {"keep": "filter_keep boolean"}),
        (speakers, {"decision": "decision string"}),
        (align, {"keep": "align_keep boolean", "reason": "align_reason string", "similarity": "similarity double", "forced_text": "forced_text string"}),
    )
    for table, columns in wanted:
        pairs = [(old, *new.split()) for old, new in columns.items()]
        if table is None:
            rows = rows.withColumns({new: F.lit(None).cast(kind) for _, new, kind in pairs})
        else:
            rows = rows.join(table.select("path", *[F.col(old).alias(new) for old, new, _ in pairs]), "path", "left")
    known = align.select("path", F.lit(True).alias("_known")) if align is not None else None
    rows = rows.join(known, "path", "left") if known is not None else rows.withColumn("_known", F.lit(None).cast("boolean"))
    return rows.withColumn("aligned", F.coalesce("_known", F.lit(False))).drop("_known")


def missing_keys(required: DataFrame, present: DataFrame, *key: str) -> DataFrame:
    return required.join(present.select(*key).distinct(), list(key), "left_anti")


def whitelisted(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    return rows.join(names.select(key).distinct(), key, "left_semi")


def engines(annotation: DataFrame, *transcripts: DataFrame) -> DataFrame:
    """Annotation rows with each engine's transcript: text_1, logprob_1, has_1 and so on."""
    rows = annotation
    for k, table in enumerate(transcripts, 1):
        keyed = engine_map(table)
        rows = rows.join(keyed.select("name", F.col("text").alias(f"text_{k}"), F.col("avg_logprob").alias(f"logprob_{k}"), F.lit(True).alias(f"has_{k}")), "name", "left")
        rows = rows.withColumn(f"has_{k}", F.coalesce(f"has_{k}", F.lit(False)))
    return rows


def crosscheck(second: DataFrame, first: DataFrame) -> DataFrame:
    """Second-pass rows (name, text) with the first pass's text; ``note`` tells those without one."""
    return second.join(first.select("name", F.col("text").alias("text_first")), "name", "left").withColumn("note", F.when(F.col("text_first").isNull(), "no_pass1"))


def rehydrate(curated: DataFrame, manifest: DataFrame, key: str = "dataset_path") -> DataFrame:
    """The manifest's full rows of curated keys, with the curated reasons."""
    return manifest.join(curated.select(key, "reasons"), key)


def with_phonemes(manifest: DataFrame, features: DataFrame) -> DataFrame:
    return manifest.withColumn("name", basename(F.col("dataset_path"))).join(features.select("name", "phones"), "name", "left")


def compare_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("name", F.col("text").alias("old_text"), F.col("avg_logprob").alias("old_logprob")).join(new.select("name", F.col("text").alias("new_text"), F.col("avg_logprob").alias("new_logprob")), "name")


def assets(candidates: DataFrame, raw: DataFrame, wav: DataFrame) -> DataFrame:
    """Candidates (source_id) with their raw and wave files (path), matched by the id before the first underscore of the file name."""
    rows = candidates
    for files, name in ((raw, "raw_path"), (wav, "wav_path")):
        keyed = files.select(F.split(basename(F.col("path")), "_", 2)[0].alias("source_id"), F.col("path").alias(name)).groupBy("source_id").agg(F.min(name).alias(name))
        rows = rows.join(keyed, "source_id", "left")
    return rows


def complete_keys(tables: list[DataFrame], key: str) -> DataFrame:
    """Keys that every table has."""
    return reduce(lambda a, b: a.join(b.select(key).distinct(), key, "left_semi"), tables[1:], tables[0].select(key).distinct())


def key_counts(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(part, rows, keys) of each table and of their intersection: a complete set has equal numbers of keys."""
    each = [t.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys")).select(F.lit(n).alias("part"), "rows", "keys") for n, t in tables.items()]
    common = complete_keys(list(tables.values()), key).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("all").alias("part"), "rows", F.col("rows").alias("keys"))
    return reduce(DataFrame.unionByName, [*each, common])


def union_last_wins(key: str, *tables: DataFrame) -> DataFrame:
    """Rows of all tables, for equal keys the last table's."""
    every = reduce(DataFrame.unionByName, [t.withColumn("_part", F.lit(k)) for k, t in enumerate(tables)])
    columns = tables[0].columns
    best = every.groupBy(key).agg(F.max_by(F.struct(*columns), "_part").alias("_row"))
    return best.select("_row.*")


def union_of_keys(key: str, *tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [t.select(key) for t in tables]).distinct()


def except_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def intersect_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def scene_overlap(items: DataFrame, wanted: list[str]) -> DataFrame:
    return items.where(F.arrays_overlap("scenes", F.array(*map(F.lit, wanted))))
