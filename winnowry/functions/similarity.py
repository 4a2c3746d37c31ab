"""Sequence similarity and normal forms, which Spark has no expression for: Arrow-batched pandas functions."""
from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from winnowry.functions.text import compact_text, no_space


def _ratio(x: str, y: str) -> float:
    if not x or not y:
        return float(not x and not y)
    return 1.0 if x == y else SequenceMatcher(None, x, y).ratio()


@F.pandas_udf(DoubleType())
def _matcher_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def _edit_rate(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    def rate(r: str, h: str) -> float:
        if not r:
            return float(bool(h))
        blocks = [(0, 0, 0), *SequenceMatcher(None, r, h).get_matching_blocks()]  # the last one is empty, at both ends
        gaps = [(b[0] - a[0] - a[2], b[1] - a[1] - a[2]) for a, b in zip(blocks, blocks[1:])]
        return sum(map(max, gaps)) / len(r)

    return pd.Series([rate(r or "", h or "") for r, h in zip(ref, hyp, strict=True)], dtype="float64")


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def similarity_ratio(a: Column, b: Column) -> Column:
    """Matching-block ratio of texts without white space. The order of arguments matters."""
    return _matcher_ratio(no_space(a), no_space(b))


def similarity(a: Column, b: Column) -> Column:
    """The same of compact texts."""
    return _matcher_ratio(compact_text(a), compact_text(b))


def char_error_rate(ref: Column, hyp: Column) -> Column:
    """Edits by matching blocks over the reference's length; an upper bound of the Levenshtein rate."""
    return _edit_rate(compact_text(ref), compact_text(hyp))


def nfkc_key(text: Column, lower: bool = True) -> Column:
    """NFKC, without white space, in lower case unless told otherwise."""
    form = F.regexp_replace(F.coalesce(_nfkc(text), F.lit("")), r"(?U)\s", "")
    return F.lower(form) if lower else form


def accept_correction(old: Column, new: Column, least: float = 0.72) -> Column:
    """The rewritten text if it isn't blank and is similar enough, else the old one."""
    blank = F.length(no_space(new)) == 0
    return F.when(~blank & (similarity_ratio(old, new) >= least), new).otherwise(old)
