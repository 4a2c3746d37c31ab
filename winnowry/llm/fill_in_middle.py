"""Fill-in-middle transformation by lookaround splitting.

A unit grammar says which characters end or begin a unit; it is translated to a regular expression that matches no character but the place
between two neighbouring ones, and Spark's ``split`` at such places keeps all pieces. Two places drawn from a hash of the document's
id part the pieces into prefix, middle and suffix. Everything is a DataFrame expression of the row: no shuffle, no Python worker.

Defined results:
* a null text is empty; an empty text has no units and stays as it is;
* a text that holds a sentinel stays as it is (form ``plain``): so what is written can always be undone;
* a null id is drawn for like the id ''; repeated rows are transformed alike; extra columns are kept apart and ignored; an empty table gives
  an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 7
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that are transformed, and of these the share written suffix first.
RATE, SUFFIX_FIRST = 100, 50

#: Unit grammars as (the characters before a boundary, the characters after it); each a regular expression of one place in the text's neighbourhood.
#: ``line``: [^\n]*\n|[^\n]+   ``word``: \s*\S+|\s+   ``character``: every code point   ``paragraph``: lines up to and with blank ones
#: ``clause``: up to and with a run of closing marks
UNITS = {
    "line": (r"\n", r"[\s\S]"),
    "word": (r"\S", r"\s"),
    "character": (r"[\s\S]", r"[\s\S]"),
    "paragraph": (r"\n\n", r"[^\n]"),
    "clause": (r"[.!?;。！？；]", r"[^.!?;。！？；]"),
}


def boundary(before: str, after: str) -> str:
    """The zero-width expression of a place between these neighbours."""
    return f"(?<={before})(?={after})"


def units(text: Column, unit: str = "line") -> Column:
    """The text's units, in order; their concatenation is the text. '' has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(*UNITS[unit]), -1))


def draws(key: Column, seed: int, n: int) -> list[Column]:
    """n numbers below 2^32: the 8-digit groups of the hex sha256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def write(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column) -> Column:
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    left = lambda mark: F.substring_index(head, mark, 1)
    right = lambda mark: F.substring_index(head, mark, -1)
    psm = F.concat(F.substring_index(left(SUFFIX), PREFIX, -1), middle, right(SUFFIX))
    spm = F.concat(right(PREFIX), middle, F.substring_index(left(PREFIX), SUFFIX, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix, middle, suffix, output) a row; prefix, middle and suffix are null where the form is plain."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("id"), seed, 4)
    rows = rows.withColumns({"units": units(F.col("text"), unit), "h1": h1, "h2": h2, "h3": h3, "h4": h4}).withColumn("n", F.size("units").cast("long"))
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumns({"low": F.least(one, two).cast("int"), "high": F.greatest(one, two).cast("int"), "form": form})
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    rows = rows.withColumns({"prefix": part(F.lit(1), F.col("low")), "middle": part(F.col("low") + 1, F.col("high") - F.col("low")), "suffix": part(F.col("high") + 1, F.size("units") - F.col("high"))})
    return rows.select("id", "n", "form", "prefix", "middle", "suffix", write(F.col("form"), F.col("prefix"), F.col("middle"), F.col("suffix"), F.col("text")).alias("output"))
