"""Sources: JSON stage tables, annotation and feature lists, file listings, embeddings, event lines."""
from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnowry.functions.text import basename, strip
from winnowry.schemas import schema
from winnowry.sources.scratch import written


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_json_list(spark: SparkSession, path: str, ddl: str, required: bool = True, lines: bool = False) -> DataFrame:
    """A JSON array of records under an explicit schema. A missing file is an error if required, else an empty table; malformed JSON and anything but an array of objects
    is an error. An array is one document, which one task parses (2 GB at most a file): large tables are JSON lines, read in splits with ``lines``."""
    if not exists(spark, path):
        if required:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema(ddl))
    if lines:
        return spark.read.schema(schema(ddl)).json(path, mode="FAILFAST")
    raw = spark.read.text(path, wholetext=True)
    items = F.when(F.ltrim(F.col("value")).startswith("["), F.from_json("value", f"ARRAY<STRUCT<{fields(ddl)}>>", {"mode": "FAILFAST"})).otherwise(F.raise_error(F.lit(f"not a list: {path}")))
    return raw.select(F.posexplode(items).alias("ordinal", "x")).select("x.*")


def read_json_array(spark: SparkSession, path: str, ddl: str, depth: int = 1) -> DataFrame:
    """(columns, ordinal): the objects of a JSON array, read in splits; ``depth`` 2 for the only array of a document {..., "items": [...]}. Files of a folder follow each other by
    name. Malformed objects are an error; text outside the objects isn't checked.

    Spark cuts the files after each closing brace. Whether a piece begins within a string follows from the quotes before it, and its depth from the brackets before it that
    aren't in strings: sums over a split's pieces, and over the splits before, a row each. An object ends where a brace brings the depth back to the array's."""
    raw = spark.read.text(path, lineSep="}").select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    # escaped characters neither open nor close; no piece begins after a backslash
    rows = raw.withColumn("plain", F.regexp_replace("value", r"(?s)\\.", "")).withColumn("quotes", F.regexp_count("plain", F.lit('"')))
    rows = _with_before(written(rows, "pieces"), "quotes")
    inside = F.col("quotes_before") % 2 == 1
    bare = F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), "plain"), '(?s)"[^"]*("|$)', "")
    cut = ((F.col("quotes") + inside.cast("int")) % 2 == 0).cast("int")  # the brace after this piece isn't in a string
    rows = rows.withColumn("bare", bare).withColumn("steps", F.regexp_count("bare", F.lit(r"[\[{]")) - F.regexp_count("bare", F.lit(r"\]")) - cut).withColumn("cut", cut)
    rows = _with_before(written(rows.drop("plain", "bare", "quotes", "quotes_before"), "depths"), "steps")
    rows = rows.withColumn("ends", ((F.col("cut") == 1) & (F.col("steps_before") + F.col("steps") == depth)).cast("int"))
    rows = _with_before(written(rows, "ends"), "ends", across_files=True)
    record = rows.groupBy(F.col("ends_before").alias("ordinal")).agg(F.max("ends").alias("whole"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("f", "b", "m", "value"))), lambda x: x["value"]), "}").alias("text"))
    head = r"^[^{]*" if depth == 1 else r'^(?:\s*,|(?:(?:[^"\[]|"(?:[^"\\]|\\.)*+")*+\[)+?)\s*'  # what stands before an object, a document's own keys and documents without items included
    text = F.regexp_replace(F.concat("text", F.lit("}")), "(?s)" + head + r"(?=\{)", "")
    parsed = record.where("whole = 1").select("ordinal", F.from_json(text, schema(ddl), {"mode": "FAILFAST"}).alias("x"))
    return parsed.select("x.*", "ordinal")


def _with_before(rows: DataFrame, amount: str, across_files: bool = False) -> DataFrame:
    """Adds ``{amount}_before``: the sum over the pieces (f, b, m) before, of the same file or of all."""
    splits = rows.groupBy("f", "b").agg(F.sum(amount).alias("k"))
    earlier = Window.partitionBy(*([] if across_files else ["f"])).orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as splits
    splits = splits.select("f", "b", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("k"))
    within = Window.partitionBy("f", "b").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(splits, ["f", "b"]).withColumn(f"{amount}_before", F.col("k") + F.coalesce(F.sum(amount).over(within), F.lit(0))).drop("k")


def fields(ddl: str) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in schema(ddl))


def read_items(spark: SparkSession, path: str, ddl: str, strict: bool = False) -> DataFrame:
    """A list of records or a document {version, items}, with each record's ordinal. Other shapes are an error if strict, else no rows."""
    raw = spark.read.text(path, wholetext=True)
    bare = F.ltrim(F.col("value")).startswith("[")
    listed = F.from_json("value", f"ARRAY<STRUCT<{fields(ddl)}>>")
    wrapped = F.from_json("value", f"STRUCT<items: ARRAY<STRUCT<{fields(ddl)}>>>")["items"]
    items = F.when(bare, listed).otherwise(wrapped)
    if strict:
        items = F.coalesce(items, F.raise_error(F.lit(f"neither a list nor a document with items: {path}")).cast(f"ARRAY<STRUCT<{fields(ddl)}>>"))
    return raw.select(F.posexplode(items).alias("ordinal", "x")).select("x.*", F.col("ordinal").cast("long").alias("ordinal"))


def _one_per_key(rows: DataFrame, key: tuple[str | Column, ...], pick, ordinal: str) -> DataFrame:
    names = [f"_k{k}" for k in range(len(key))]
    best = rows.groupBy(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in zip(names, key, strict=True)]).agg(pick(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.col(ordinal)).alias("_row"))
    return best.select("_row.*")


def last_wins(rows: DataFrame, *key: str | Column, ordinal: str = "ordinal") -> DataFrame:
    """One row per key, the one with the largest ordinal; by a combining aggregate, so a key that very many rows share is reduced where it's read."""
    return _one_per_key(rows, key, F.max_by, ordinal)


def first_wins(rows: DataFrame, *key: str | Column, ordinal: str = "ordinal") -> DataFrame:
    return _one_per_key(rows, key, F.min_by, ordinal)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, value): the lines of a text file, or of a folder's files by name, in order. Files are split as Spark splits them; counts per split, a row each, give the ordinals."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    splits = lines.groupBy("f", "b").agg(F.count(F.lit(1)).alias("k"), F.min("m").alias("low"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(splits.select("f", "b", "low", before.alias("before")), ["f", "b"]).select((F.col("before") + F.col("m") - F.col("low")).alias("ordinal"), "value")


def training_assets(lines: DataFrame) -> DataFrame:
    """Asset names of a line list: stripped, without blank lines and comments, the first of equals; a path separator is an error."""
    name = strip(F.col("value"))
    names = lines.select("ordinal", name.alias("name")).where((F.col("name") != "") & ~F.col("name").startswith("#"))
    names = names.withColumn("name", F.when(F.col("name").rlike(r"[/\\]"), F.raise_error(F.concat(F.lit("not a file name: "), "name")).cast("string")).otherwise(F.col("name")))
    return first_wins(names, "name")


def missing_assets(names: DataFrame, files: DataFrame) -> DataFrame:
    """Names without a file in a listing (path)."""
    return names.join(files.select(basename(F.col("path")).alias("name")).distinct(), "name", "left_anti")


def require_empty(rows: DataFrame, what: str) -> None:
    first = rows.limit(5).collect()
    if first:
        raise ValueError(f"{what}: {[tuple(r) for r in first]}")


def parse_annotation(lines: DataFrame) -> DataFrame:
    """(ordinal, path, speaker, tag, text, name, lang) of lines path|speaker|TAG|text; lines of fewer fields go; the text may hold more bars."""
    parts = F.split("value", r"\|", 4)
    rows = lines.withColumn("p", parts).where(F.size("p") == 4)
    get = lambda k: F.get("p", F.lit(k))
    return rows.select("ordinal", get(0).alias("path"), get(1).alias("speaker"), get(2).alias("tag"), get(3).alias("text"), basename(get(0)).alias("name"), F.when(F.upper(get(2)).isin("JP", "JA"), "ja").otherwise("zh").alias("lang"))


def engine_map(rows: DataFrame) -> DataFrame:
    """Transcripts keyed by name, else by the file name of path; the last of equals."""
    return last_wins(rows.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), basename(F.col("path")))).where(F.coalesce("name", F.lit("")) != ""), "name")


def parse_features(lines: DataFrame) -> DataFrame:
    """(name, phones): lines of at least two tab-separated columns, the last of equal names."""
    parts = F.split("value", "\t")
    rows = lines.where(F.size(parts) >= 2).select("ordinal", F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("phones"))
    return last_wins(rows, "name").drop("ordinal")


def list_files(spark: SparkSession, path: str, ending: str = "", prefix: str = "") -> DataFrame:
    """(path, name, size): metadata only; prefix and ending are literal text, never patterns."""
    files = spark.read.format("binaryFile").load(path).select("path", basename(F.col("path")).alias("name"), F.col("length").alias("size"))
    return files.where(F.col("name").startswith(prefix) & F.col("name").endswith(ending))


def wav_durations(spark: SparkSession, path: str) -> DataFrame:
    """(path, duration) of wave files; 0 where a file can't be read."""

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            seconds = []
            for raw in pdf["content"]:
                try:
                    with wave.open(io.BytesIO(bytes(raw))) as w:
                        seconds.append(w.getnframes() / w.getframerate())
                except (wave.Error, EOFError, ZeroDivisionError):
                    seconds.append(0.0)
            yield pd.DataFrame({"path": pdf["path"], "duration": seconds})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(go, "path string, duration double")


def read_embeddings(spark: SparkSession, path: str, key: str, vector: str) -> DataFrame:
    """(key, vector) as double, L2-normalised; vectors of different lengths are an error."""
    from winnowry.functions.numeric import l2_normalise

    rows = spark.read.parquet(path).select(F.col(key).alias("key"), F.col(vector).alias("vector")).where("vector is not null")
    sizes = rows.select(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if sizes[0] != sizes[1]:
        raise ValueError("vectors of different lengths")
    return rows.select("key", l2_normalise(F.col("vector")).alias("vector"))


def merge_searches(*pages: DataFrame) -> DataFrame:
    """Records of several searches, the last of equal ids."""
    every = None
    for k, page in enumerate(pages):
        page = page.withColumn("_search", F.lit(k))
        every = page if every is None else every.unionByName(page)
    order = Window.partitionBy("source_id").orderBy(F.desc("_search"), F.desc("ordinal"))
    return every.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn", "_search")


def select_candidates(ids: DataFrame, *caches: DataFrame) -> DataFrame:
    """ids (ordinal, source_id) with their record from the first cache that has one; defaults for the others."""
    found = None
    for k, cache in enumerate(caches):
        cache = last_wins(cache, "source_id").select("source_id", "title", "author", "duration", "pubdate", "play", F.lit(k).alias("_cache"))
        found = cache if found is None else found.unionByName(cache)
    best = found.withColumn("_rn", F.row_number().over(Window.partitionBy("source_id").orderBy("_cache"))).where("_rn = 1")
    rows = first_wins(ids, "source_id").join(best, "source_id", "left")
    return rows.select("ordinal", "source_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("author", F.lit("")).alias("author"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("duration", "pubdate", "play")])


def stream_deltas(lines: DataFrame, keep_all: bool = False) -> DataFrame:
    """Text deltas of 'data: {json}' lines of three chat protocols; lines that aren't JSON, and the end mark, are skipped, or kept without a delta."""
    body = F.regexp_extract("value", r"^data:\s*(\{.*\})\s*$", 1)
    delta = F.coalesce(F.get_json_object(body, "$.choices[0].delta.content"), F.get_json_object(body, "$.delta.text"), F.get_json_object(body, "$.candidates[0].content.parts[0].text"))
    rows = lines.withColumn("delta", delta)
    return rows if keep_all else rows.where("delta is not null")


def answering_attempt(lines: DataFrame) -> DataFrame:
    """Lines (request_id, attempt, ordinal, value) of requests that were tried again: the deltas of the first attempt that brought any. A request is
    tried again only before its first delta, so attempts after that one aren't read."""
    deltas = stream_deltas(lines)
    first = deltas.groupBy("request_id").agg(F.min("attempt").alias("attempt"))
    return deltas.join(first, ["request_id", "attempt"], "left_semi").select("request_id", "attempt", "ordinal", "delta")


def split_events(raw: Column) -> Column:
    """struct(events, rest): blocks that a blank line ends, and what follows the last of them."""
    blocks = F.split(raw, "\n\n", -1)
    return F.struct(F.filter(F.slice(blocks, F.lit(1), F.size(blocks) - 1), lambda b: b != "").alias("events"), F.element_at(blocks, -1).alias("rest"))


def parse_event(block: Column) -> Column:
    """The typed event of an SSE block; null unless its type is one of the five."""
    event = F.from_json(F.regexp_extract(block, r"^data:\s?(.*)$", 1), "type STRING, index INT, text STRING, audio STRING, message STRING")
    return F.when(event["type"].isin("sentence", "audio", "audio_error", "error", "done"), event)


def read_document(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """One JSON object under a schema; no rows if the file is missing, malformed or not an object."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema(ddl))
    raw = spark.read.text(path, wholetext=True).where(F.ltrim("value").startswith("{"))
    return raw.select(F.from_json("value", schema(ddl)).alias("x")).where(F.col("x").isNotNull()).select("x.*")


def style_clips(bank: DataFrame) -> DataFrame:
    """bank: styles map<string, struct<primary: struct<...>>> -> (style, audio, prompt_text, lang, clip_id); unknown styles and clips without audio or text go."""
    from winnowry.functions.speech import STYLES

    rows = bank.select(F.explode("styles").alias("style", "block")).select("style", F.col("block.primary").alias("c"))
    rows = rows.where(F.col("style").isin(*STYLES) & (F.coalesce("c.audio", F.lit("")) != "") & (F.coalesce("c.prompt_text", F.lit("")) != ""))
    return rows.select("style", F.col("c.audio").alias("audio"), strip(F.col("c.prompt_text")).alias("prompt_text"), F.coalesce("c.lang", F.lit("zh")).alias("lang"), F.coalesce("c.id", "style").alias("clip_id"))
