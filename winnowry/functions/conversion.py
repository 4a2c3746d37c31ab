"""Conversion of texts by a table of phrases: from left to right, the longest entry that stands at a place is replaced.

Places where an entry may stand come from the windows' hashes of ``operators.substrings``; only they are compared. The table goes to the tasks, so its
size is bounded: tables of conversions are dictionaries, and a larger one is an error.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from winnowry.operators.substrings import BLOCK_CHARS, PhraseIndex, window_hashes

#: Bytes of a table's phrases.
MAX_TABLE_BYTES = 4 << 20


def convert(texts: list[str], index: PhraseIndex, replaced: list[str]) -> list[str]:
    """Texts with the index's phrases replaced."""
    whole, ends = "".join(texts), np.cumsum([len(t) for t in texts])
    longest: dict[int, int] = {}  # the longest phrase at a place
    for n, hashes in window_hashes(whole).items():
        if n in index.anchors:
            known = index.anchors[n]
            place, key = known.find(hashes)
            stop = ends[np.searchsorted(ends, place, "right")]
            for p, k, end in zip(place.tolist(), key.tolist(), stop.tolist(), strict=True):
                for v in known.values[known.first[k] : known.last[k]].tolist():
                    phrase = index.phrases[v]
                    if p + len(phrase) <= end and len(phrase) > len(index.phrases[longest[p]] if p in longest else "") and whole.startswith(phrase, p):
                        longest[p] = v
    out, places, at = [], sorted(longest), 0
    next_ = 0
    for end in ends.tolist():
        parts = []
        while next_ < len(places) and places[next_] < end:
            p = places[next_]
            next_ += 1
            if p >= at:  # not within what was replaced
                parts += [whole[at:p], replaced[longest[p]]]
                at = p + len(index.phrases[longest[p]])
        parts.append(whole[at:end])
        at = end
        out.append("".join(parts))
    return out


def longest_match(table: DataFrame) -> Callable[[Column], Column]:
    """A conversion by a table (phrase, replacement); of equal phrases the smallest replacement counts, empty and null ones are left out. Null texts stay null."""
    rows = table.where("phrase <> '' AND replacement IS NOT NULL").groupBy("phrase").agg(F.min("replacement").alias("replacement"))
    size = rows.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    if size > MAX_TABLE_BYTES:
        raise ValueError(f"the phrases of a conversion table have {size} bytes, more than {MAX_TABLE_BYTES}")
    pairs = rows.orderBy("phrase").collect()
    index, replaced = PhraseIndex([r[0] for r in pairs]), [r[1] for r in pairs]

    @F.pandas_udf(StringType())
    def go(texts: pd.Series) -> pd.Series:
        said = texts.dropna()
        out: list[str] = []
        low, values = 0, said.tolist()
        while low < len(values):
            high, chars = low, 0
            while high < len(values) and (high == low or chars + len(values[high]) <= BLOCK_CHARS):
                chars += len(values[high])
                high += 1
            out += convert(values[low:high], index, replaced)
            low = high
        return pd.Series(out, index=said.index, dtype=object).reindex(texts.index).where(texts.notna(), None)

    return go
