"""Alignment of two tokenizers' tokens by the bytes that they cover.

A whole run of texts is laid out end to end: every token of A and of B has an end in its bytes. One count of ends a side marks where
tokens end; where both end, the run is cut into groups, and sums of the marks, taken at the texts' bounds, give each text's results.
Between two neighbouring ends of either side lies one pair of tokens that overlap: a link.

Neither tokenizer has a token across a single blank between other characters, so a block's texts are split there and each distinct part is
encoded once; a text's tokens are its parts' in order.

Counts of linked id pairs over the corpus are summed per block before they're shuffled. A block then asks for its distinct
pairs' counts, and its texts, kept as packed places of these pairs, sum them.

Defined results:
* null and empty texts, and texts whose bytes one of the tokenizers doesn't give back (with a blank put before), have no tokens: zeros and '';
* marks such as ``<|endoftext|>`` or ``<s>`` within a text are plain text;
* repeated rows count as often as they come; null document ids are kept; extra columns are ignored; an empty table gives an empty result;
* texts above ``CHUNK_CHARS`` are encoded in parts, cut before a single blank, where neither vocabulary has a token across; without such a
  place a part is longer.
"""
from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._arrow import blocks
from ._blocks import BLOCK_BYTES, numbered, pack_ints, runs, unpack_ints
from ._parts import Parts
from ._store import materialise

#: Bytes of text that are laid out at once.
RUN_BYTES = 1 << 20
CHUNK_CHARS = 1 << 20
ENCODE_ROWS = 50_000
#: Ids stay below this in both vocabularies; larger ones are refused.
MOST_IDS = 1 << 17
BLANK = "▁"


def parts(text: str, size: int) -> list[str]:
    """The text in parts of about ``size`` characters, cut before single blanks between letters or digits."""
    out, low = [], 0
    while len(text) - low > size:
        cut = re.compile(r"(?<=[^\W_]) (?=[^\W_])").search(text, low + size)
        if cut is None:
            break
        out.append(text[low : cut.start()])
        low = cut.start()
    return [*out, text[low:]]


def _table(spelt: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The bytes of each id, and their number."""
    if len(spelt) > MOST_IDS:
        raise ValueError(f"more than {MOST_IDS} ids")
    return pa.array(spelt, pa.binary()), np.asarray([len(x) for x in spelt], np.int64)


class ByteLevel:
    """A byte-level BPE file of the tokenizers library: ids of blank + text, and the bytes of each id."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError(f"{path} isn't a byte-level vocabulary with its own splitter")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        known = self.tokenizer.get_vocab(with_added_tokens=True)
        spelt = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            spelt[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.table, self.width = _table(spelt)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [parts(" " + t, CHUNK_CHARS) for t in texts]
        found = iter(self.tokenizer.encode_batch_fast([p for s in split for p in s], add_special_tokens=False))
        return [np.concatenate([np.asarray(next(found).ids, np.int64) for _ in s]) for s in split]


class Pieces:
    """A sentencepiece model that puts a blank before a text: ids of the text, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.table, self.width = _table([bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(BLANK, " ").encode() for i, n in enumerate(names)])
        #: whether no piece goes on after letters into a blank: only then may texts be encoded in parts
        self.parted = not any(re.search(f"[^{BLANK}]{BLANK}", n) for n in names)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [parts(t, CHUNK_CHARS) if self.parted else [t] for t in texts]
        found = iter(self.model.encode([p[1:] if k else p for s in split for k, p in enumerate(s)], num_threads=1))
        return [np.concatenate([np.asarray(next(found), np.int64) for _ in s]) for s in split]


@lru_cache(4)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@lru_cache(4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Coded:
    """One tokenizer's ids of a list of parts, and the bytes of its tokens."""

    def __init__(self, tokenizer: ByteLevel | Pieces, parts_: list[str]):
        ids = [x for low in range(0, len(parts_), ENCODE_ROWS) for x in tokenizer.encode(parts_[low : low + ENCODE_ROWS])]
        self.flat = np.concatenate([*ids, np.zeros(0, np.int64)])
        self.at = runs(np.asarray([len(x) for x in ids], np.int64))
        self.lists = pa.ListArray.from_arrays(pa.array(self.at.astype(np.int32)), pa.array(self.flat.astype(np.int32)))
        self.width = tokenizer.width
        table = tokenizer.table.take(pa.array(self.flat)).cast(pa.large_binary())
        data = bytes(table.buffers()[2] or b"")
        end = runs(self.width[self.flat])[self.at].tolist()
        self.gives_back = np.asarray([data[low:high] == b" " + p.encode() for p, low, high in zip(parts_, end[:-1], end[1:], strict=True)], bool)


class Side:
    """One tokenizer's tokens of a run of texts, laid out end to end. ``part``: parts of the texts, ``at``: where each text's begin."""

    def __init__(self, coded: Coded, part: np.ndarray, at: np.ndarray):
        self.ids = coded.lists.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.width = coded.width
        self.count = np.diff(runs(np.diff(coded.at)[part])[at])


class Run:
    """Texts laid out and cut; see the module. ``n_bytes``: of each text, with its blank."""

    def __init__(self, a: Side, b: Side, n_bytes: np.ndarray):
        self.a, self.b = a, b
        bounds = runs(n_bytes)
        n = int(bounds[-1])
        ends_a, ends_b = np.cumsum(a.width[a.ids]), np.cumsum(b.width[b.ids])
        at_a, at_b = np.bincount(ends_a, minlength=n + 1), np.bincount(ends_b, minlength=n + 1)
        both, either = at_a & at_b, at_a | at_b
        cuts, links = np.cumsum(both), np.cumsum(either)
        self.groups, self.links = np.diff(cuts[bounds]), np.diff(links[bounds])
        # a group ends where a token of each side ends: the group of a token is the number of cuts before its end
        self.group_a, self.group_b = cuts[ends_a] - both[ends_a], cuts[ends_b] - both[ends_b]
        self.last_a, self.last_b = at_b[ends_a] > 0, at_a[ends_b] > 0
        stop = np.flatnonzero(either)
        self.pair_a, self.pair_b = a.ids[np.cumsum(at_a)[stop] - at_a[stop]], b.ids[np.cumsum(at_b)[stop] - at_b[stop]]

    def digests(self) -> list[str]:
        """sha256 of a text's groups, `a1,a2|b1;a3|b2,b3`; '' without tokens."""
        a, b = self.a, self.b
        # in front of a token of A stand all tokens of B of earlier groups, in front of one of B all of A up to its own group
        n_groups = int(self.groups.sum())
        before_a, before_b = runs(np.bincount(self.group_b, minlength=n_groups)), runs(np.bincount(self.group_a, minlength=n_groups))
        order = np.empty(len(a.ids) + len(b.ids), np.int64)
        order[np.arange(len(a.ids)) + before_a[self.group_a]] = a.ids + MOST_IDS * self.last_a
        order[np.arange(len(b.ids)) + before_b[self.group_b + 1]] = b.ids + MOST_IDS * 2 * self.last_b
        names = _names()
        told = names.take(pa.array(order)).cast(pa.large_binary())
        data = memoryview(told.buffers()[2]) if len(order) else memoryview(b"")
        at = np.frombuffer(told.buffers()[1], np.int64)[runs(a.count + b.count)].tolist() if len(order) else [0] * (len(a.count) + 1)
        return [hashlib.sha256(data[low : high - 1]).hexdigest() if high > low else "" for low, high in zip(at[:-1], at[1:], strict=True)]


@lru_cache(1)
def _names() -> pa.Array:
    """The decimal of each id with what follows it: a comma, the bar after a group's A, the semicolon after its B."""
    return pa.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(MOST_IDS)], pa.binary())


class Block:
    """A block's texts as parts, each distinct part encoded once by both."""

    def __init__(self, texts: pa.Array, path_a: str, path_b: str):
        va, vb = byte_level(path_a), pieces(path_b)
        found = Parts(texts, not vb.parted)
        self.at, self.part, parts_ = found.at, found.part, found.names.to_pylist()
        self.a, self.b = Coded(va, parts_), Coded(vb, parts_)
        ok = self.a.gives_back & self.b.gives_back & np.asarray([bool(p) for p in parts_], bool)
        self.ok = np.diff(np.concatenate(([0], np.cumsum(~ok[self.part])))[self.at]) == 0
        self.size = np.where(self.ok, found.n_bytes + 1, 0)

    def run(self, low: int, high: int) -> Run:
        """Texts low to high; those that aren't given back have no parts here."""
        ok = self.ok[low:high]
        count = np.diff(self.at[low : high + 1])
        part = self.part[self.at[low] : self.at[high]][np.repeat(ok, count)]
        at = runs(np.where(ok, count, 0))
        return Run(Side(self.a, part, at), Side(self.b, part, at), self.size[low:high])


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def align(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (id, text) to rows of two kinds: a document's results with ``pairs``, the packed places of its links' id pairs in its block's list (in order); and the
    block's distinct pairs with the number of their links, as packed lists ``a``, ``b``, ``n``."""
    kind = docs.schema["id"].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in numbered(batches, 1, block_bytes):
            texts, found, keys, sizes = Block(rows.column(1), path_a, path_b), [], [], []
            for low, high, _, _ in blocks(rows.column(1), RUN_BYTES):
                run = texts.run(low, high)
                found += zip(run.a.count.tolist(), run.b.count.tolist(), run.groups.tolist(), run.links.tolist(), run.digests(), strict=True)
                keys.append(run.pair_a * MOST_IDS + run.pair_b)
                sizes.append(run.links)
            coded = pa.array(np.concatenate(keys)).dictionary_encode()
            pairs, place = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)
            n, at = np.bincount(place, minlength=len(pairs)), runs(np.concatenate(sizes))
            packed = [pack_ints(np.diff(np.sort(place[low:high]), prepend=0)) for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            no = lambda t: pa.nulls(len(packed), t)
            lists = pa.list_(pa.int32())
            yield batch(block, rows.column(0), *columns, pa.array(packed, pa.binary()), no(lists), no(lists), no(pa.list_(pa.int64())))
            one = lambda x, t: pa.array([x], pa.list_(t))
            yield batch(block, pa.nulls(1, rows.column(0).type), *[pa.nulls(1, c.type) for c in columns], pa.nulls(1, pa.binary()), one(pairs // MOST_IDS, pa.int32()), one(pairs % MOST_IDS, pa.int32()), one(n, pa.int64()))

    names = ["block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "a", "b", "n"]

    def batch(block: int, *columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), block)), *columns], names)

    return docs.mapInArrow(go, f"block long, id {kind}, {ALIGNED}, pairs binary, a array<int>, b array<int>, n array<long>")


def pair_counts(each: DataFrame) -> DataFrame:
    """(a, b, links, best): links of each id pair over the corpus from rows (a, b, n), and whether no other pair of b has more. A window
    holds the pairs of one b, at most as many as A has ids."""
    links = each.groupBy("a", "b").agg(F.sum("n").alias("links"))
    return links.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))


def _told(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    pairs = pairs.sort_by("place")
    links, best = pairs["links"].to_numpy(), pairs["best"].to_numpy()
    places = [np.cumsum(unpack_ints(x)) for x in docs["pairs"].to_pylist()]
    sums = [(int(best[p].sum()), int(links[p].sum())) for p in places]
    out = docs.drop_columns(["own_block", "pairs"])
    return out.append_column("n_best", pa.array([s[0] for s in sums], pa.int64())).append_column("count_sum", pa.array([s[1] for s in sums], pa.int64()))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Documents (id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum), and the table of id pairs (a, b, links, best)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    table = materialise(align(rows, path_a, path_b, block_bytes), "aligned")
    each = table.where("a is not null").select("block", F.posexplode(F.arrays_zip("a", "b", "n")).alias("place", "p")).select("block", "place", "p.a", "p.b", "p.n")
    counts = materialise(pair_counts(each), "pair_counts")
    told = each.select("block", "place", "a", "b").join(counts, ["a", "b"]).select("block", "place", "links", "best")
    own = table.where("a is null").select(F.col("block").alias("own_block"), "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs")
    found = own.groupBy("own_block").cogroup(told.groupBy("block")).applyInArrow(_told, f"id {kind}, {ALIGNED}, n_best long, count_sum long")
    return found, counts
