"""Sinks: committed tables, numbered outputs, annotation lines, upserts, adjudicated updates, event lines."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnowry.functions.text import language_tag
from winnowry.operators.windows import in_order
from winnowry.sources.scratch import written


def write_table(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Replace a table. Each file appears whole, but on a plain file system a reader may find the table half replaced: write to a new path and switch readers
    where that matters. A NaN in a double column is an error, as JSON has none."""
    for name, kind in rows.dtypes:
        if kind in ("double", "float"):
            rows = rows.withColumn(name, F.when(F.isnan(name), F.raise_error(F.lit(f"NaN in {name}")).cast(kind)).otherwise(F.col(name)))
    rows.write.mode("overwrite").format(form).save(path)


#: Bytes of rows that ``write_json_arrays`` sends to a worker at once; a longer row is sent alone.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def write_json_arrays(rows: DataFrame, path: str, head: str = "[", tail: str = "]") -> None:
    """The rows as JSON arrays, one a task in a file of its own, an object a line. Rows go through one by one, so an array may be of any size. ``head`` and ``tail`` stand
    around the objects."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda values: pa.RecordBatch.from_arrays([values], ["value"])
        before = head
        for batch in batches:
            if batch.num_rows:
                yield told(pc.binary_join_element_wise(pa.array([before, *[","] * (batch.num_rows - 1)]), batch.column(0), ""))
                before = ","
        yield told(pa.array([tail if before == "," else head + tail]))

    spark = rows.sparkSession
    limit = spark.conf.get(_LIMIT, None)
    spark.conf.set(_LIMIT, BATCH_BYTES)
    try:
        rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(go, "value string").write.text(path)
    finally:
        spark.conf.set(_LIMIT, limit) if limit is not None else spark.conf.unset(_LIMIT)


def numbered(rows: DataFrame, order: list, form: str, *parts: Column, name: str = "output_name", group: list | None = None) -> DataFrame:
    """A dense number by the order, within groups if given, put through a printf form with further parts. Numbers over all rows are given range by range."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    if group:
        return rows.withColumn(name, F.format_string(form, F.row_number().over(Window.partitionBy(*group).orderBy(*order)), *parts))
    return in_order(rows, *order).withColumn(name, F.format_string(form, F.col("_place"), *parts)).drop("_place")


def dataset_names(kept: DataFrame, order: list, width: int = 3) -> DataFrame:
    tag = F.lower(F.when(F.col("lang") == "ja", "jp").otherwise(F.col("lang")))
    return numbered(kept, order, f"%0{width}d_%s.wav", tag)


def annotation_lines(rows: DataFrame, speaker: str, path: str = "path", lang: str = "lang", text: str = "text") -> DataFrame:
    """path|speaker|TAG|text; bars in the text become slashes."""
    return rows.withColumn("value", F.concat_ws("|", F.col(path), F.lit(speaker), language_tag(F.col(lang)), F.replace(F.col(text), F.lit("|"), F.lit("/"))))


def write_dataset(selected: DataFrame, out: str, speaker: str, stats: DataFrame | None = None, thresholds: DataFrame | None = None) -> None:
    """Annotation lines, manifest, and if given statistics and thresholds, each a table under ``out``. The manifest's names are numbered by (score desc, path)."""
    named = dataset_names(selected, [F.desc("score"), "path"], 5).withColumnRenamed("output_name", "dataset_path")
    write_table(named, f"{out}/manifest")
    manifest = selected.sparkSession.read.parquet(f"{out}/manifest")
    annotation_lines(manifest, speaker, "dataset_path").select("value").write.mode("overwrite").text(f"{out}/annotation")
    for rows, name in ((stats, "stats"), (thresholds, "thresholds")):
        if rows is not None:
            write_table(rows, f"{out}/{name}", "json")


def stale_outputs(existing: DataFrame, current: DataFrame, pattern: str = r"^\d{3}_[a-z]{2}\.wav$") -> DataFrame:
    """Numbered files (name) that this run doesn't refer to."""
    return existing.where(F.col("name").rlike(pattern)).join(current.select(F.col("output_name").alias("name")), "name", "left_anti")


def split_decisions(decided: DataFrame, out: str) -> None:
    """Kept rows, dropped rows and a histogram of tiers, each a table under ``out``. The input is computed once."""
    decided = written(decided, "decided")
    write_table(decided.where("decision = 'keep'"), f"{out}/manifest")
    decided.where("decision <> 'keep'").write.mode("overwrite").json(f"{out}/dropped")
    write_table(decided.groupBy("decision", "tier").count(), f"{out}/report", "json")


def listen_pack(sample: DataFrame, path: str) -> None:
    """Tab-separated, with tabs and line ends in the text as spaces."""
    sample.withColumn("text", F.translate("text", "\t\n\r", "   ")).write.mode("overwrite").csv(path, sep="\t", header=True)


def validation_report(checks: DataFrame) -> tuple[bool, str]:
    """Whether all checks pass, and the report as Markdown. There are as many rows as checks."""
    rows = checks.orderBy("id").collect()
    passed = all(r["pass"] for r in rows)
    lines = ["# Validation", "", "| check | pass | detail |", "|---|---|---|", *[f"| {r['id']} | {'yes' if r['pass'] else 'no'} | {r['detail']} |" for r in rows], "", f"ready: {'yes' if passed else 'no'}"]
    return passed, "\n".join(lines)


def append_whitelist(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """(ordinal, key): the old list, then new entries that it lacks, in order."""
    both = old.select(F.lit(0).alias("part"), "ordinal", key).unionByName(new.select(F.lit(1).alias("part"), "ordinal", key))
    first = both.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy("part", "ordinal"))).where("_rn = 1")
    return first.select(F.struct("part", "ordinal").alias("place"), key)


def require_ready(assets: DataFrame, statuses: DataFrame) -> DataFrame:
    """Assets whose audit status isn't ready (or unknown): nothing may be appended while there are any."""
    return assets.join(statuses.where("status = 'ready'").select("name"), "name", "left_anti")


def mark_status(plan: DataFrame, changes: DataFrame) -> DataFrame:
    """The plan with the statuses of ``changes`` (source_id, status) in place of its own."""
    new = changes.select("source_id", F.col("status").alias("_new")).dropDuplicates(["source_id"])
    return plan.join(new, "source_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new").select(*plan.columns)


def pending(inputs: DataFrame, cache: DataFrame, key: str, version: tuple[str, int] | None = None) -> DataFrame:
    """Inputs that the cache lacks, or holds in another version only."""
    known = cache if version is None else cache.where(F.col(version[0]) == version[1])
    return inputs.join(known.select(key).distinct(), key, "left_anti")


def upsert(cache: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The cache with new rows in place of old ones of the same key."""
    return cache.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def sse_event(payload: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n"))


def apply_adjudication(store: DataFrame, decisions: DataFrame, key: str = "name", text: str = "text") -> DataFrame:
    """A store without dropped rows and with new texts where a decision brings one. Order and other columns stay."""
    gone = decisions.where("decision = 'drop'").select(key).distinct()
    new = decisions.where("decision = 'keep' and text_new is not null").select(key, F.col("text_new").alias("_new")).dropDuplicates([key])
    return store.join(gone, key, "left_anti").join(new, key, "left").withColumn(text, F.coalesce("_new", text)).drop("_new").select(*store.columns)


def merge_parts(parts: DataFrame, header: str | None = None) -> DataFrame:
    """Lines of shard files (shard, ordinal, value) in the shards' order, with an optional header; no line at all is an error."""
    if parts.isEmpty():
        raise ValueError("no part has a line")
    rows = parts.select("shard", "ordinal", "value")
    if header is not None:
        rows = rows.unionByName(parts.sparkSession.range(1).select(F.lit(-1).alias("shard").cast(rows.schema["shard"].dataType), F.lit(-1).cast("long").alias("ordinal"), F.lit(header).alias("value")))
    return rows.orderBy("shard", "ordinal").select("value")


def replace_lines(lines: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """Lines (ordinal, key, value) with regenerated ones in place, in the old order."""
    return lines.join(new.select(key, F.col("value").alias("_new")).dropDuplicates([key]), key, "left").select("ordinal", key, F.coalesce("_new", "value").alias("value")).orderBy("ordinal")
