"""Best-fit packing by sum of squares.

Documents are tokenised in the scan (Arrow batches) and cut into pieces; only (id, piece, length) rows travel on.
A full piece is a sequence of its own. The others are dealt into groups of about ``group_rows`` rows by a hash, and
each group is packed by one task, longest pieces first: a piece goes to the open sequence with room for it by which the sum
over gaps g of N(g)^2 becomes smallest, N(g) being the number of open sequences with g tokens left; a new sequence is opened
only where none has room. Then the pieces of the group's loosest sequences are dealt once more, each to the tightest gap, and stay so if that
takes fewer sequences. (With a new sequence as one more choice of the same rule, sf0.01 takes 487 sequences and sf0.1
4947; so it takes 481 and 4936, which the tokens alone need.)

Defined results:
* a null text is empty; an empty text is one piece of one token, the separator;
* a document of more than ``capacity`` tokens is cut so that all pieces but the first are full;
* repeated rows are packed as often as they come; extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import bisect
import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import blocks, remembered
from ._blocks import renumbered, runs
from ._parts import Parts
from ._store import materialise

CAPACITY = 2048
SEPARATOR = 0
#: Rows that one task packs. A row takes about 100 bytes there.
GROUP_ROWS = 50_000
#: Parts that are encoded at once, and bytes of text whose parts are.
ENCODE_ROWS = 50_000
BLOCK_BYTES = 8 << 20
#: Parts whose ids a worker remembers, the first that it meets, and the longest of them in bytes: about 40 MB.
CACHE_PARTS, LONGEST_CACHED = 1_000_000, 24


class Encoder:
    """Ids of a block's texts. The splitter of byte-level files never joins what stands around a single blank, so there parts between blanks are encoded
    apart, each distinct one of a block once, and the commonest once a worker; with other files whole texts are."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        self.known, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())
        self.by_parts = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
        self.by_parts = self.by_parts and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin (n + 1)."""
        found = Parts(texts, not self.by_parts)
        first = np.zeros(len(found.part), bool)
        first[found.at[:-1]] = True  # a text has a part at least; its first has no blank before it
        kinds, part = renumbered(found.part * 2 + first, 2 * len(found.names))
        head = pa.array(np.where(kinds & 1, "", " "), pa.string())
        places, ids = self._ids(pc.binary_join_element_wise(head, found.names.take(pa.array(kinds >> 1)), ""))
        taken = ids.take(pa.array(places[part]))
        begin = np.frombuffer(taken.buffers()[1], np.int64)[: len(part) + 1] // 4 if len(part) else np.zeros(1, np.int64)
        data = taken.buffers()[2]
        return np.frombuffer(data, "<u4")[: int(begin[-1])] if data is not None else np.zeros(0, "<u4"), begin[found.at]

    def _ids(self, names: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Where each part's ids stand in a column of ids, as little-endian bytes."""
        places = pc.index_in(names, value_set=self.known)
        new = names.filter(pc.is_null(places))
        told = []
        for low in range(0, len(new), ENCODE_ROWS):
            told += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(new.slice(low, ENCODE_ROWS).to_pylist(), add_special_tokens=False)]
        fresh = pa.array(told, pa.large_binary())
        out = places.to_numpy(zero_copy_only=False).copy()
        out[np.isnan(out)] = len(self.known) + np.arange(len(new))
        ids = pa.concat_arrays([self.ids, fresh])
        if room := CACHE_PARTS - len(self.known):
            short = pc.less_equal(pc.binary_length(new), LONGEST_CACHED)
            self.known, self.ids = pa.concat_arrays([self.known, new.filter(short)[:room]]), pa.concat_arrays([self.ids, fresh.filter(short)[:room]])
        return out.astype(np.int64), ids


def encoder(path: str) -> Encoder:
    if path not in remembered:
        remembered[path] = Encoder(path)
    return remembered[path]


PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece of each document: id, piece, start, length, ids_crc32."""
    end = np.asarray([separator], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for low, high, _, _ in blocks(batch.column(1), BLOCK_BYTES):
                part = batch.slice(low, high - low)
                flat, bounds = enc.encode(part.column(1))
                out: list[tuple] = []
                for i, begin, stop in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    ids = flat[begin:stop].astype("<u4").tobytes() + end
                    n = stop - begin + 1
                    at = 0
                    for k, to in enumerate(range(n % capacity or capacity, n + 1, capacity)):
                        out.append((i, k, at, to - at, zlib.crc32(ids[at * 4 : to * 4])))
                        at = to
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["id", "piece", "start", "length", "ids_crc32"])
                pa.default_memory_pool().release_unused()  # workers stay for the next stages

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the order given: of the open bins with room each goes where the sum of squared counts of open bins by gap becomes
    smallest, the smallest gap first. Half the change of that sum is N(g - s) - N(g) + 1 for a bin of gap g, 1/2 - N(s) where the bin is filled."""
    count = np.zeros(capacity + 1)
    shut = np.full(capacity + 1, np.inf)  # 0 where a gap has an open bin
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, s in enumerate(lengths.tolist()):
        change = count[: capacity - s] - count[s:capacity] + shut[s:capacity]
        change += 1
        if len(change) and change[0] < np.inf:
            change[0] = 0.5 - count[s]
        k = int(change.argmin()) if len(change) else 0
        if len(change) and change[k] < np.inf:
            gap = s + k
            b = bins[gap].pop()
            count[gap] -= 1
            if not bins[gap]:
                shut[gap] = np.inf
        else:
            b, gap = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += s
        if left := gap - s:
            bins[left].append(b)
            count[left] += 1
            shut[left] = 0
    return where, offset


#: How many of a group's sequences are dealt once more: tried in this order until fewer come of it.
LOOSEST = (32, 64, 128, 256, 512)


def tightest(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in the order given, each in the tightest gap that holds it."""
    gaps: list[tuple[int, int]] = []
    fill: list[int] = []
    place, at = [], []
    for s in lengths:
        i = bisect.bisect_left(gaps, (s, -1))
        if i < len(gaps):
            b = gaps.pop(i)[1]
        else:
            b = len(fill)
            fill.append(0)
        place.append(b)
        at.append(fill[b])
        fill[b] += s
        bisect.insort(gaps, (capacity - fill[b], b))
    return place, at


def tighten(lengths: np.ndarray, where: np.ndarray, offset: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the pieces of the loosest bins dealt anew, if that takes fewer bins. Bins stay numbered without holes."""
    fill = np.bincount(where, weights=lengths)
    order = np.argsort(fill, kind="stable")
    for n in LOOSEST if len(where) else ():
        loose = np.sort(order[:n])
        if -(-int(fill[loose].sum()) // capacity) >= len(loose):
            continue  # their tokens alone need as many
        some = np.flatnonzero(np.isin(where, loose))
        place, at = tightest(lengths[some].tolist(), capacity)
        if max(place) + 1 < len(loose):
            where, offset = where.copy(), offset.copy()
            where[some], offset[some] = loose[place], at
            return np.unique(where, return_inverse=True)[1], offset
    return where, offset


PACKED = PIECES + ", sequence_id long, offset long"


def pack(cut: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Place pieces in sequences: adds sequence_id and offset. ``cut`` is a table that can be read again."""
    short = cut.where(F.col("length") < capacity)
    groups = max(1, round(short.count() / group_rows))
    own = cut.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "piece"], ascending=[False, True, True], kind="stable")
        lengths = pdf["length"].to_numpy()
        where, offset = tighten(lengths, *sum_of_squares(lengths, capacity), capacity)
        group = pdf.pop("group")
        return pdf.assign(sequence_id=where * groups + group.to_numpy(), offset=offset)

    packed = (
        short.withColumn("group", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(groups)).cast("long"))
        .groupBy("group").applyInPandas(place, PACKED)
    )
    return packed.unionByName(own)


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, group_rows: int = GROUP_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer_path, capacity, separator, id_col, text_col), "pieces")
    packed = pack(cut, capacity, group_rows)
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
