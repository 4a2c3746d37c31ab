"""BPE encoding and decoding by a table of distinct words.

Texts are split at ASCII white space in the scan; each block of rows lists its distinct words once, dealt by a hash into
shards. A shard's task encodes each of its distinct words once, whatever number of blocks ask for it, and the ids go back to
the blocks, where the places of a text's words turn into its ids. To decode, a block's distinct ids are joined with the broadcast table of
ids and pieces, as large as the vocabulary, and the pieces at a text's ids spell it. Only distinct words and their ids are
shuffled: places are written in buckets by block and stay there.

It holds for vocabularies that drop white space: whose splitter keeps matches without white space only, so that ids of words
join to the ids of a text. ``Vocabulary`` checks this when it loads a file and refuses others. Such a file has no decoder: the
library joins pieces by blanks.

Defined results:
* a null text is empty; empty texts and texts of white space have no ids and decode to '';
* marks such as ``<|endoftext|>`` within a text are special ids, as the library reads them; white space other than ASCII stays within a word and
  is left to the library;
* repeated rows and null document ids give a row each; extra columns are ignored; an empty table gives an empty result;
* a text longer than a block is a block of its own; a word of any length is one word.
"""
from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import BLOCK_BYTES, numbered, pack_ints, runs, unpack_ints
from ._store import bucketed, materialise, partitions

#: Bytes of text to a shard: no shard's words can have more, and they have far less.
SHARD_BYTES = 64 << 20
#: Words that are turned into ids at once when a block's rows are put together.
MERGE_WORDS = 1 << 18


class Vocabulary:
    """A vocabulary file whose units hold no white space; see the module."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        first = steps[0]
        if not (first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and spec.get("decoder") is None and spec.get("post_processor") is None):
            raise ValueError(f"words of {path} can't be encoded apart: its splitter doesn't drop white space, or it has a decoder or post-processor")
        if any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"]):
            raise ValueError(f"special pieces of {path} take in white space")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def pieces(self) -> list[tuple[int, str]]:
        return sorted((i, p) for p, i in self.tokenizer.get_vocab(with_added_tokens=True).items())


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def shard_of(words: list[bytes], shards: int) -> np.ndarray:
    """The shard of each word, by a hash of its bytes."""
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % shards


def pack_words(words: list[bytes]) -> bytes:
    """Words in order, deflated; none holds a line end, as they're parts between white space."""
    return zlib.compress(b"\n".join(words), 1)


def unpack_words(packed: bytes) -> list[str]:
    return zlib.decompress(packed).decode().split("\n")


def by_count(counts: np.ndarray) -> np.ndarray:
    """The order in which words are numbered: the most frequent first, so that most places are small numbers."""
    return np.argsort(-counts, kind="stable")


def split(docs: DataFrame, shards: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (id, text) to rows of two kinds: (block, id, places) a document, and (block, shard, words, counts) a block's distinct words of a shard, in order, with how
    often they occur. Places number a block's words, listed shard by shard, by their counts."""
    kind = docs.schema["id"].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in numbered(batches, 1, block_bytes):
            listed = pc.ascii_split_whitespace(pc.fill_null(rows.column(1), ""))
            coded = listed.flatten().dictionary_encode()
            ids, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.binary())
            sorted_ = pc.sort_indices(words).to_numpy()
            names = words.take(pa.array(sorted_)).to_pylist()
            shard = shard_of(names, shards)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(ids, minlength=len(names))[sorted_][order]
            place = np.empty(len(order), np.int64)
            place[sorted_[order][by_count(counts)]] = np.arange(len(order))
            places, at = place[ids], runs(pc.list_value_length(listed).to_numpy(zero_copy_only=False))
            packed = [pack_ints(places[low:high]) for low, high in zip(at[:-1], at[1:], strict=True)]
            n = len(packed)
            yield batch(block, rows.column(0), pa.array(packed, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()))
            used, first = np.unique(shard[order], return_index=True)
            cut = list(zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True))
            own = [pack_words([names[k] for k in order[low:high].tolist()]) for low, high in cut]
            often = [pack_ints(counts[low:high]) for low, high in cut]
            yield batch(block, pa.nulls(len(used), rows.column(0).type), pa.nulls(len(used), pa.binary()), pa.array(used, pa.int32()), pa.array(own, pa.binary()), pa.array(often, pa.binary()))

    def batch(block: int, *columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), block)), *columns], ["block", "id", "places", "shard", "words", "counts"])

    return docs.mapInArrow(go, f"block long, id {kind}, places binary, shard int, words binary, counts binary")


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(block, shard, words, counts) to (block, shard, counts, sizes, ids): each distinct word is encoded once, by its shard's task."""

    def go(rows: pa.Table) -> pa.Table:
        asked = [unpack_words(x) for x in rows["words"].to_pylist()]
        known = {w: k for k, w in enumerate(dict.fromkeys(w for x in asked for w in x))}
        ids = vocabulary(path).encode(list(known))
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        table = pa.array(ids, pa.list_(pa.int32()))
        places = [np.fromiter(map(known.__getitem__, x), np.int64, len(x)) for x in asked]
        flat = [table.take(pa.array(p)).flatten().to_numpy(zero_copy_only=False) for p in places]
        return pa.table({
            "block": rows["block"], "shard": rows["shard"], "counts": rows["counts"],
            "sizes": pa.array([pack_ints(length[p]) for p in places], pa.binary()), "ids": pa.array([pack_ints(x) for x in flat], pa.binary()),
        })

    return words.groupBy("shard").applyInArrow(go, "block long, shard int, counts binary, sizes binary, ids binary")


def pieces(spark, path: str) -> DataFrame:
    """(piece_id, piece): the vocabulary, a row an id; its file bounds it."""
    return spark.createDataFrame(vocabulary(path).pieces(), "piece_id int, piece string")


def _joined(flat: pa.Array, at: np.ndarray) -> pa.Array:
    """Binary values that are runs of the values of another binary column, from at[k] to at[k + 1]."""
    flat = flat.cast(pa.large_binary())
    begin = np.frombuffer(flat.buffers()[1], np.int64)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(begin[at]), flat.buffers()[2]])


def _speller(known: pa.Table):
    """Puts a block's documents together; ``known`` is the table of ids and pieces."""

    def go(docs: pa.Table, words: pa.Table) -> pa.Table:
        words = words.sort_by("shard")
        joined = lambda name: np.concatenate([*map(unpack_ints, words[name].to_pylist()), np.zeros(0, np.int64)])
        order, flat, at = by_count(joined("counts")), joined("ids"), runs(joined("sizes"))
        spelt = pa.table({"piece_id": pa.array(np.unique(flat).astype(np.int32))}).join(known, "piece_id").sort_by("piece_id")
        place_of = np.zeros(int(flat.max(initial=0)) + 1, np.int64)
        place_of[spelt["piece_id"].to_numpy()] = np.arange(spelt.num_rows)
        piece = pa.array([p + " " for p in spelt["piece"].to_pylist()], pa.string()).cast(pa.binary())
        # each word once: its ids as bytes, and its pieces, each with a blank behind
        word_text = _joined(piece.take(pa.array(place_of[flat])), at).take(pa.array(order))
        word_ids = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * 4), pa.py_buffer(flat.astype("<u4"))]).take(pa.array(order))
        out_ids, out_text, packed, low = [], [], docs["places"].to_pylist(), 0
        while low < len(packed):
            some, n = [], 0
            while low < len(packed) and n < MERGE_WORDS:
                some.append(unpack_ints(packed[low]))
                n += len(some[-1])
                low += 1
            places, cut = pa.array(np.concatenate(some)), runs(np.asarray([len(x) for x in some], np.int64))
            out_ids.append(_joined(word_ids.take(places), cut).cast(pa.binary()))
            out_text.append(pa.array([x[:-1] for x in _joined(word_text.take(places), cut).to_pylist()], pa.binary()).cast(pa.string()))
        ids, text = pa.chunked_array(out_ids, pa.binary()), pa.chunked_array(out_text, pa.string())
        pa.default_memory_pool().release_unused()
        return pa.table({"id": docs["id"], "n_tokens": pc.divide(pc.binary_length(ids), 4).cast(pa.int64()), "ids": ids, "decoded": text})

    return go


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_tokens, ids, decoded) a row: the ids as little-endian unsigned 32-bit integers, and the text that they decode to."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(partitions(spark), -(-size // SHARD_BYTES))
    table = bucketed(split(rows, shards, block_bytes), "bpe_split", "block", partitions(spark))
    words = encode_words(table.where("shard is not null").select("block", "shard", "words", "counts"), path)
    known = pieces(spark, path).toArrow()
    kind = rows.schema["id"].dataType.simpleString()
    own = table.where("shard is null").select(F.col("block").alias("own_block"), "id", "places")
    return own.groupBy("own_block").cogroup(words.groupBy("block")).applyInArrow(_speller(known), f"id {kind}, n_tokens long, ids binary, decoded string")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): documents from their ids (array<int>) by a join of id and piece. An id without a piece is an error; null or empty ids give ''."""
    rows = encoded.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    rows = materialise(rows, "bpe_ids")
    each = rows.select("row", F.posexplode("ids").alias("place", "piece_id")).join(F.broadcast(pieces(encoded.sparkSession, path)), "piece_id", "left")
    piece = F.coalesce("piece", F.raise_error(F.concat(F.lit("no piece has the id "), F.col("piece_id").cast("string"))).cast("string"))
    text = each.groupBy("row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", piece.alias("piece")))), lambda x: x["piece"]), " ").alias("text"))
    return rows.join(text, "row", "left").select(F.col("id").alias(id_col), F.coalesce("text", F.lit("")).alias("text"))
