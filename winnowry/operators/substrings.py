"""Which phrases stand in which texts, or texts in phrases, without comparing all with all.

A string's anchor is its longest beginning of 1, 2, 4, 8 or 16 characters. Where a string stands in another, its anchor does, so hashes of all
windows of these lengths tell the places worth a comparison; a window's hash comes from those of its halves, for all places of a block at
once. Phrases of a measured size go to the tasks as an index, and texts aren't shuffled. Larger tables are joined on (length, hash of anchor).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnowry.sources.scratch import written

ANCHORS = (1, 2, 4, 8, 16)
#: Phrases go to the tasks up to this many bytes (their index takes some 60 times that).
MAX_INDEX_BYTES = 4 << 20
BLOCK_CHARS = 1 << 20
_FILTER = 1 << 20
#: Bits of the map of anchors in a join: 8 MB. Beyond 4 million anchors more windows than needed are joined.
MAX_BITS = 1 << 26
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def window_hashes(text: str) -> dict[int, np.ndarray]:
    """For each anchor length the hashes of the windows at all places."""
    h = _mixed(np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + _ODD)
    out = {}
    for n in ANCHORS:
        if len(h) == 0:
            break
        out[n] = h
        h = _mixed(h[:-n] * _ODD + h[n:]) if len(h) > n else h[:0]
    return out


def anchor_length(n: int) -> int:
    return max(k for k in ANCHORS if k <= n)


def anchor(text: str) -> tuple[int, int]:
    n = anchor_length(len(text))
    return n, int(window_hashes(text[:n])[n][0])


class _Places:
    """Values by hash: sorted hashes, where each one's values begin, and a bit map in front."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.first = np.unique(hashes[order], return_index=True)
        self.values, self.last = values[order], np.append(self.first[1:], len(order))
        self.seen = np.zeros(_FILTER, bool)
        self.seen[(hashes & np.uint64(_FILTER - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among ``hashes``, index of the hash) of those that are known."""
        maybe = np.flatnonzero(self.seen[(hashes & np.uint64(_FILTER - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[maybe]
        return maybe[hit], at[hit]


class PhraseIndex:
    def __init__(self, phrases: list[str]):
        self.phrases = phrases
        self.longest = max(map(len, phrases), default=0)
        by: dict[int, list[tuple[int, int]]] = {}
        for k, p in enumerate(phrases):
            n, h = anchor(p)
            by.setdefault(n, []).append((h, k))
        self.anchors = {n: _Places(np.array([h for h, _ in x], np.uint64), np.array([k for _, k in x])) for n, x in by.items()}
        whole = "".join(phrases)
        self.ends = np.cumsum([len(p) for p in phrases])
        self.whole, self.windows = whole, {n: _Places(h, np.arange(len(h))) for n, h in window_hashes(whole).items()}

    def within(self, texts: list[str]) -> set[tuple[int, int]]:
        """(text, phrase) where the phrase stands in the text."""
        whole, ends = "".join(texts), np.cumsum([len(t) for t in texts])
        out: set[tuple[int, int]] = set()
        for n, hashes in window_hashes(whole).items():
            if n not in self.anchors:
                continue
            known = self.anchors[n]
            place, key = known.find(hashes)
            row = np.searchsorted(ends, place, "right")
            checked: set[tuple[int, int]] = set()  # phrases that are their anchor are the same at all of a text's places
            for p, k, r in zip(place.tolist(), key.tolist(), row.tolist(), strict=True):
                if (r, k) in checked:
                    continue
                only = True
                for v in known.values[known.first[k] : known.last[k]].tolist():
                    phrase = self.phrases[v]
                    only &= len(phrase) == n
                    if p + len(phrase) <= ends[r] and (r, v) not in out and whole.startswith(phrase, p):
                        out.add((r, v))
                if only and all((r, v) in out for v in known.values[known.first[k] : known.last[k]].tolist()):
                    checked.add((r, k))
        return out

    def around(self, text: str) -> list[int]:
        """Phrases longer than the text in which it stands."""
        if not 0 < len(text) < self.longest:
            return []
        n, h = anchor(text)
        known = self.windows.get(n)
        if known is None:
            return []
        found = set()
        for k in known.find(np.array([h], np.uint64))[1].tolist():
            for p in known.values[known.first[k] : known.last[k]].tolist():
                v = int(np.searchsorted(self.ends, p, "right"))
                if v not in found and p + len(text) <= self.ends[v] and len(self.phrases[v]) > len(text) and self.whole.startswith(text, p):
                    found.add(v)
        return sorted(found)


def substring_pairs(texts: DataFrame, phrases: DataFrame, both_ways: bool = True, index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """(key, p): a row for each row of ``texts`` (key, text) and each different phrase of ``phrases`` (p) that stands in the text, or (``both_ways``) in which the text
    stands. Null and empty strings stand in nothing."""
    phrases = phrases.select("p").where("p <> ''").distinct()
    texts = texts.select("key", "text").where("text <> ''")
    size = phrases.agg(F.sum(F.octet_length("p"))).first()[0] or 0
    if size > index_bytes:
        return _joined(texts, phrases, both_ways)
    index = PhraseIndex([r[0] for r in phrases.orderBy("p").collect()])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, low = batch.column(1).to_pylist(), 0
            while low < len(names):
                high, chars = low, 0
                while high < len(names) and (high == low or chars + len(names[high]) <= BLOCK_CHARS):
                    chars += len(names[high])
                    high += 1
                met = sorted(index.within(names[low:high]))
                if both_ways:
                    met += [(k, v) for k, t in enumerate(names[low:high]) for v in index.around(t)]
                rows = pa.array([low + r for r, _ in met], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([index.phrases[v] for _, v in met], pa.string())], ["key", "p"])
                low = high

    return texts.mapInArrow(go, f"key {texts.schema['key'].dataType.simpleString()}, p string")


def _bit_map(anchors: DataFrame) -> np.ndarray:
    """Bits of the hashes, about 16 for each up to MAX_BITS in all; it only spares work, as what it passes is joined. The driver gets a row for each 32 bits that are used."""
    bits = min(max(1 << (16 * anchors.count()).bit_length(), 1 << 10), MAX_BITS)
    rows = anchors.selectExpr(f"shiftright(h & {bits - 1}L, 5) AS w", "shiftleft(1L, CAST(h & 31 AS INT)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(bits // 32, np.uint32)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).astype(np.uint32)
    return out


def _in_map(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    bit = hashes & np.uint64(len(known) * 32 - 1)
    return (known[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)


def _joined(texts: DataFrame, phrases: DataFrame, both_ways: bool) -> DataFrame:
    """The same by joins. Each string's anchor meets the different windows of the others; what meets is compared. Windows whose hash is no anchor's aren't written; a pair meets once
    a direction, and the whole strings are shuffled once, by their own row, not once a pair."""
    texts = written(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
    phrases = written(phrases.withColumn("phrase", F.monotonically_increasing_id()), "phrases")

    def anchors(rows: DataFrame, name: str, column: str) -> DataFrame:
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [anchor(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int32()), pa.array([np.uint64(h).astype(np.int64) for _, h in found], pa.int64())], [name, "n", "h"])

        # an anchor has 16 characters at most; longer heads would be sent for nothing
        return rows.select(name, F.substring(column, 1, max(ANCHORS))).mapInArrow(go, f"{name} long, n int, h long")

    def windows(rows: DataFrame, name: str, column: str, known: np.ndarray) -> DataFrame:
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple[int, int, np.ndarray]] = []
                held = 0
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for n, h in window_hashes(t).items():
                        h = np.unique(h[_in_map(h, known)])
                        if len(h):
                            out.append((i, n, h))
                            held += len(h)
                    if held >= _FILTER:
                        yield told(out)
                        out, held = [], 0
                if out:
                    yield told(out)

        def told(out: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
            many = [len(h) for _, _, h in out]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat([i for i, _, _ in out], many)), pa.array(np.repeat(np.array([n for _, n, _ in out], np.int32), many)), pa.array(np.concatenate([h for _, _, h in out]).view(np.int64))], [name, "n", "h"])

        return rows.select(name, column).mapInArrow(go, f"{name} long, n int, h long")

    heads = written(anchors(phrases, "phrase", "p"), "heads")
    met = windows(texts, "row", "text", _bit_map(heads)).join(heads.join(phrases, "phrase"), ["n", "h"]).select("row", "p")
    pairs = met.join(texts, "row").where(F.col("text").contains(F.col("p"))).select("key", "p")
    if both_ways:
        longest = phrases.agg(F.max(F.length("p"))).first()[0] or 0
        shorter = texts.where(F.length("text") < longest)
        short = written(anchors(shorter, "row", "text"), "heads")
        met = short.join(windows(phrases, "phrase", "p", _bit_map(short)), ["n", "h"]).select("row", "phrase").join(phrases, "phrase")
        # equal strings met in the other direction
        around = met.join(shorter, "row").where((F.length("p") > F.length("text")) & F.col("p").contains(F.col("text"))).select("key", "p")
        pairs = pairs.unionByName(around)
    return pairs
