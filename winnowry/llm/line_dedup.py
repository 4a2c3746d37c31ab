"""Line dedup by an exact set-similarity join.

A line is its set of words (A-Z lower-cased); lines without words are left alone. Lines with
the same set form a class, which its earliest line (by document id and line number) stands for. Two classes are linked
if their sets' Jaccard similarity is at least ``SIMILAR / OF``. A line is removed if an earlier line has its set, or one linked to it.

1. Words are ordered by rarity: by the count of their hash bucket over the whole corpus (2^16 counters, whatever the
   corpus), then by hash. Any order is correct; this one makes common words rare in prefixes.
   Sets of fewer than ``LEAST_LINKED`` words can't be linked with another set, so their classes are whole without the join.
2. The first n - ceil(t n) + 1 words of a line are its prefix; linked lines share a word there. Postings (word, class,
   length, position, 128-bit map of the set) meet word by word; length, positional and bit-map filters leave few classes
   with a possible partner of which the word may be the first in common. Only classes and such words are written, not pairs.
3. The sets of those classes meet at those words again; a pair is counted where its first common word is, verified on the
   whole sets, and each task returns for each class its number of links and its earliest linked line: rows grow with
   the classes, not with the pairs.

Words in the prefixes of very many lines (lines made from one template share their rarest words) are split: their classes
are dealt into blocks of about ``BLOCK`` and each two blocks meet in a task of their own, in both joins. The counts that
decide it are of all lines.

Defined results: a null text has one empty line; lines without words are kept; rows that repeat an id number
their lines alike, so equal lines of theirs count as one line, and a line goes from all of them if it goes from one; extra
columns stay as they are; rows without id come before all others, and drop_lines leaves them whole; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import SPACE, U64, binary_array, blocks, mix, spans, text_bytes, tidy, word_hashes
from ._store import lookup, materialise, partitions, small_batches

SIMILAR, OF = 85, 100
MIN_WORDS = 1
#: Different sets share at most n of n + 1 words, so the smallest of which one may be linked has this many.
LEAST_LINKED = -(-SIMILAR // (OF - SIMILAR))
COUNTERS = 1 << 16
#: Counters that a row holds.
ROW_COUNTERS = 1 << 10
#: Postings that a task of the join holds on average.
TASK_POSTINGS = 200_000
#: Bytes of sets that a task of the second join holds on average, at most.
TASK_BYTES = 32 << 20
#: Classes of a word that meet in one block.
BLOCK = 4096
#: Sets of a word that are compared with their neighbours one offset at a time; more are sorted by length and place first.
FEW = 2048
#: Largest number of blocks of a word, 16 bits of a part's number.
MOST_BLOCKS = 1 << 15
BLOOM_BITS = 1 << 23
WORD_SPACE = SPACE
#: Bits of a word's hash (or rank and hash) that are enough to sort a block's lines by, so that ties of different words in a line are rare.
LEAST_BITS = 32
#: Bytes of texts that are read together: their arrays of 8 bytes a byte stay in a core's cache.
TEXT_BYTES = 1 << 18


def order_of(line: np.ndarray, rest: np.ndarray, words: np.ndarray, exact) -> np.ndarray:
    """Order by line (below 2^20, ascending), then by 44 bits of ``rest``, as one number each; where that leaves different words in a tie, the order that ``exact`` gives.
    Numbers that have room for the places too are sorted themselves, which takes half as long as sorting places by them."""
    if not len(words) or line[-1] >= 1 << 20:
        return exact()
    low = (len(words) - 1).bit_length()
    width = min(44, 64 - low - int(line[-1]).bit_length())
    if width >= LEAST_BITS:
        key = line.astype(U64) << U64(width + low)
        key |= (rest & U64((1 << 44) - 1)) >> U64(44 - width) << U64(low)
        key |= np.arange(len(words), dtype=U64)
        key.sort()
        order = (key & U64((1 << low) - 1)).astype(np.int64)
        key >>= U64(low)
        tied = np.flatnonzero(key[1:] == key[:-1])
    else:
        key = line.astype(U64) << U64(44) | rest & U64((1 << 44) - 1)
        order = np.argsort(key)
        tied = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    return exact() if (words[order[tied + 1]] != words[order[tied]]).any() else order


def line_sets(data: np.ndarray, at: np.ndarray, ranks: np.ndarray | None = None):
    """Of a block: each line's document and number, the hashes of its distinct words (sorted, by rarity if the buckets' ranks are given), and where each line's begin."""
    ends_line = np.flatnonzero(data == 10) + 1
    doc_of_break = np.searchsorted(at, ends_line - 1, "right") - 1
    per_doc = np.bincount(doc_of_break, minlength=len(at) - 1) + 1 if len(at) > 1 else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(per_doc)])
    doc = np.repeat(np.arange(len(at) - 1), per_doc)
    number = np.arange(len(doc)) - first[doc]
    begin = np.empty(len(doc), np.int64)
    begin[first[:-1]] = at[:-1]
    begin[first[doc_of_break] + 1 + np.arange(len(ends_line)) - np.concatenate([[0], np.cumsum(per_doc - 1)])[doc_of_break]] = ends_line
    starts, ends = spans(data, at, ~WORD_SPACE)
    words = word_hashes(data, starts, ends)
    # lines with equal beginnings are empty ones before the last; a word belongs to the last line that begins at or before it
    line = np.repeat(np.arange(len(doc)), np.diff(np.searchsorted(starts, begin, "left"), append=len(starts)))
    order = order_of(line, words >> U64(20), words, lambda: np.lexsort((words, line))) if ranks is None else by_rarity(words, line, ranks)
    words, line = words[order], line[order]
    if len(words):
        new = np.ones(len(words), bool)
        new[1:] = (words[1:] != words[:-1]) | (line[1:] != line[:-1])
        words, line = words[new], line[new]
    return doc, number, words, np.searchsorted(line, np.arange(len(doc) + 1), "left"), line


def keys_of(words: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each set, as rows."""
    out = np.empty((len(of) - 1, 2), U64)
    for k, salt in enumerate((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)):
        total = np.concatenate([[U64(0)], np.cumsum(mix(words ^ U64(salt)), dtype=U64)])
        out[:, k] = mix(total[of[1:]] - total[of[:-1]] + np.diff(of).astype(U64))
    return out


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - -(-SIMILAR * n // OF) + 1


def bucket_of(words: np.ndarray) -> np.ndarray:
    return (words >> U64(48)).astype(np.int64)


def by_rarity(words: np.ndarray, line: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The order that sorts each line's words by rarity; words come line by line. ranks: of the buckets."""
    rank = ranks[bucket_of(words)]
    return order_of(line, rank.astype(U64) << U64(28) | words >> U64(20) & U64((1 << 28) - 1), words, lambda: np.lexsort((words, rank, line)))


#: Stands for a null id inside.
NO_ID = -(1 << 63)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))


def lines_of(texts: DataFrame) -> DataFrame:
    """(id, line, n, key, set): a row per line; key names its set, null without words; set is the key's first half.
    Rows with a bucket hold no line but k, how many words a task has read of ROW_COUNTERS buckets from that one on."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        total = np.zeros(COUNTERS, np.int64)
        names = ["id", "line", "n", "key", "set", "bucket", "k"]
        for batch in batches:
            for low, high, data, at in blocks(batch.column(1), TEXT_BYTES):
                doc, number, words, of, _ = line_sets(data, at)
                total += np.bincount(bucket_of(words), minlength=COUNTERS)
                n = np.diff(of)
                both = keys_of(words, of)
                keys = binary_array(both.ravel(), np.arange(len(n) + 1) * 2)
                keys = pc.if_else(pa.array(n >= MIN_WORDS), keys, pa.scalar(None, pa.binary()))
                lines = [batch.column(0).slice(low, high - low).take(pa.array(doc)), pa.array(number), pa.array(n.astype(np.int32)), keys, pa.array(both[:, 0].copy().view(np.int64))]
                yield pa.RecordBatch.from_arrays([*lines, pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.list_(pa.int64()))], names)
        first = np.arange(0, COUNTERS, ROW_COUNTERS, dtype=np.int32)
        none = [pa.nulls(len(first), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(first), pa.ListArray.from_arrays(np.append(first, np.int32(COUNTERS)), total)], names)

    return texts.mapInArrow(go, "id long, line long, n int, key binary, set long, bucket int, k array<long>")


def _counters(rows: DataFrame) -> np.ndarray:
    """Sums of k by bucket, of (bucket, k)."""
    found = rows.groupBy("bucket").agg(F.sum("k").alias("k")).toPandas()
    counts = np.zeros(COUNTERS, np.int64)
    counts[found["bucket"].to_numpy(np.int64)] = found["k"].to_numpy(np.int64)
    return counts


def word_ranks(lines: DataFrame) -> np.ndarray:
    """Ranks of the hash buckets by the number of their words in the lines of the whole corpus: COUNTERS numbers."""
    ranks = np.empty(COUNTERS, np.int64)
    rows = lines.where("bucket is not null").select("bucket", F.posexplode("k").alias("place", "k")).select((F.col("bucket") + F.col("place")).alias("bucket"), "k")
    ranks[np.argsort(_counters(rows), kind="stable")] = np.arange(COUNTERS)
    return ranks


class Prefixes:
    """The prefix postings of a block: words, the line of each, its place there, and the lines' sets, lengths and words."""

    def __init__(self, data: np.ndarray, at: np.ndarray, ranks: np.ndarray):
        _, _, self.ranked, self.of, _ = line_sets(data, at, ranks)
        self.n, self.sets = np.diff(self.of), keys_of(self.ranked, self.of)[:, 0]
        _, rows = np.unique(self.sets, return_index=True)  # lines with the same set give one posting a block
        rows = np.sort(rows[self.n[rows] >= LEAST_LINKED])
        many = prefix_length(self.n[rows])
        self.line = np.repeat(rows, many)
        self.place = np.arange(len(self.line)) - np.repeat(np.cumsum(many) - many, many)
        self.words = self.ranked[self.of[self.line] + self.place]


def prefix_counts(texts: DataFrame, ranks: np.ndarray) -> np.ndarray:
    """Number of postings by hash bucket over the whole corpus: COUNTERS numbers."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, _, data, at in blocks(batch.column(1), TEXT_BYTES):
                total += np.bincount(bucket_of(Prefixes(data, at, ranks).words), minlength=COUNTERS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "k"])

    return _counters(texts.mapInArrow(go, "bucket int, k long"))


def parts_of(block: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in a block of many: the row and the number of each part that it takes part in, 0 where there is one block only, else 1 + lower block * MOST_BLOCKS + higher block."""
    row = np.repeat(np.arange(len(block)), many)
    other = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    mine = block[row]
    return row, np.where(many[row] > 1, 1 + np.minimum(mine, other) * MOST_BLOCKS + np.maximum(mine, other), 0)


def part_apart(part: np.ndarray) -> np.ndarray:
    """Whether a part is of two different blocks."""
    return (part > 0) & ((part - 1) // MOST_BLOCKS != (part - 1) % MOST_BLOCKS)


def task_of(words: np.ndarray, part: np.ndarray, tasks: int) -> np.ndarray:
    return (np.where(part > 0, mix(words + part.astype(U64)), words) % U64(tasks)).astype(np.int32)


POSTING = np.dtype([("word", "<u8"), ("set", "<u8"), ("map", "<u8", 2), ("n", "<u4"), ("at", "<u4")])


def postings(texts: DataFrame, ranks: np.ndarray, many: np.ndarray, tasks: int) -> DataFrame:
    """(task, part, blob): packed postings of every line's prefix. many: the number of blocks of the words of each bucket."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in blocks(batch.column(1), TEXT_BYTES):
                p = Prefixes(data, at, ranks)
                bit = U64(1) << (p.ranked >> U64(20) & U64(63))
                half = p.ranked >> U64(26) & U64(1)
                bits = np.stack([np.bitwise_or.reduceat(np.append(np.where(half == k, bit, U64(0)), U64(0)), p.of[:-1]) for k in (0, 1)], 1)
                split = many[bucket_of(p.words)]
                row, part = parts_of((p.sets[p.line] % split.astype(U64)).astype(np.int64), split)
                line = p.line[row]
                out = np.empty(len(row), POSTING)
                out["word"], out["set"], out["map"], out["n"], out["at"] = p.words[row], p.sets[line], bits[line], p.n[line], p.place[row]
                task = task_of(out["word"], part, tasks)
                order = np.lexsort((part, task))
                task, part, out = task[order], part[order], out[order]
                first = np.flatnonzero(np.concatenate([[True], (task[1:] != task[:-1]) | (part[1:] != part[:-1])])) if len(task) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(task[first]), pa.array(part[first]), binary_array(out, np.append(first, len(out)))], ["task", "part", "blob"])

    return texts.mapInArrow(go, "task int, part long, blob binary")


def possible(p: np.ndarray, part: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The postings whose set may be linked with another set of which their word is the first in common, by length, position and bit map."""
    order = np.lexsort((p["set"], p["n"], part, p["word"]))
    p, part = p[order], part[order]
    if len(p):
        new = np.ones(len(p), bool)
        new[1:] = (p["set"][1:] != p["set"][:-1]) | (part[1:] != part[:-1]) | (p["word"][1:] != p["word"][:-1])
        p, part = p[new], part[new]
    hit = np.zeros(len(p), bool)
    n, at, bits = p["n"].astype(np.int64), p["at"].astype(np.int64), p["map"]
    block, apart = (p["set"] % many[bucket_of(p["word"])].astype(U64)).astype(np.int64), part_apart(part)
    new = np.ones(len(p), bool)
    new[1:] = (part[1:] != part[:-1]) | (p["word"][1:] != p["word"][:-1])
    begin = np.append(np.flatnonzero(new), len(p))
    size = np.diff(begin)

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        need = -(-SIMILAR * (n[i] + n[j]) // (OF + SIMILAR))
        return (np.minimum(n[i] - at[i], n[j] - at[j]) >= need) & ((n[i] + n[j] - np.bitwise_count(bits[i] ^ bits[j]).sum(-1).astype(np.int64)) // 2 >= need) & (~apart[i] | (block[i] != block[j]))

    here, end = np.flatnonzero(np.repeat(size <= FEW, size)), np.repeat(begin[1:], size)
    for k in range(1, FEW):
        here = here[here + k < end[here]]
        here = here[OF * n[here] >= SIMILAR * n[here + k]]  # the lengths rise, so nothing further on can match either
        if not len(here):
            break
        found = here[near(here, here + k)]
        hit[found] = hit[found + k] = True
    for low, high in zip(begin[:-1][size > FEW].tolist(), begin[1:][size > FEW].tolist(), strict=True):
        # a word that many sets share: only sets of lengths and places that allow it meet, and of those the ones without a partner yet
        kinds, kind = np.unique(np.stack([n[low:high], at[low:high]], 1), axis=0, return_inverse=True)
        held = [low + np.flatnonzero(kind.ravel() == k) for k in range(len(kinds))]
        rest, length = kinds[:, 0] - kinds[:, 1], kinds[:, 0]
        able = (OF * length[:, None] >= SIMILAR * length) & (OF * length >= SIMILAR * length[:, None])
        able &= np.minimum(rest[:, None], rest) >= -(-SIMILAR * (length[:, None] + length) // (OF + SIMILAR))
        for i, j in np.argwhere(np.tril(able)).tolist():
            for x, y in ((held[i], held[j]), (held[j], held[i])):
                for first in range(0, len(x), 256):
                    rows = x[first : first + 256]
                    rows = rows[~hit[rows]]
                    close = near(rows[:, None], y[None, :]) & (rows[:, None] != y[None, :])
                    hit[rows[close.any(1)]] = True
                    hit[y[close.any(0)]] = True
    return p[hit]


def flagged(texts: DataFrame, ranks: np.ndarray, many: np.ndarray, tasks: int) -> DataFrame:
    """(set, word): the first hash of every class with a possible partner, and the words of its prefix at which there may be one."""

    def go(table: pa.Table) -> pa.Table:
        blobs = table["blob"].to_pylist()
        part = np.repeat(table["part"].to_numpy(), [len(x) // POSTING.itemsize for x in blobs])
        p = possible(np.frombuffer(b"".join(blobs), POSTING), part, many)
        return pa.table({k: pa.array(np.ascontiguousarray(p[k]).view(np.int64)) for k in ("set", "word")})

    return postings(texts, ranks, many, tasks).groupBy("task").applyInArrow(go, "set long, word long")


def marks_of(found: DataFrame) -> DataFrame:
    """(set, marks, copies): the flagged words of a set, each with the number of blocks that its sets are dealt into, and the sum of these numbers.
    Only words of several blocks are broadcast: at most a row for each BLOCK rows of ``found``."""
    found = materialise(found.distinct(), "found")
    split = found.groupBy("word").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > BLOCK)
    blocks_ = split.select("word", F.least(F.ceil(F.col("k") / BLOCK), F.lit(MOST_BLOCKS)).cast("int").alias("many"))
    dealt = found.join(F.broadcast(blocks_), "word", "left").withColumn("many", F.coalesce("many", F.lit(1)))
    return dealt.groupBy("set").agg(F.collect_list(F.struct("word", "many")).alias("marks"), F.sum("many").alias("copies"))


def bloom(sets: DataFrame) -> np.ndarray:
    """A bit map of fixed size, with a bit for each number in ``set``; it only spares work, as false hits are dropped by a join."""
    rows = sets.selectExpr(f"shiftright(pmod(set, {BLOOM_BITS}), 5) AS w", f"shiftleft(1L, CAST(pmod(set, {BLOOM_BITS}) & 31 AS INT)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(BLOOM_BITS // 32, np.uint32)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).astype(np.uint32)
    return out


def in_map(numbers: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    bit = numbers % U64(BLOOM_BITS)
    return (chosen[(bit >> U64(5)).astype(np.int64)] >> (bit & U64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)


def sets_of(texts: DataFrame, ranks: np.ndarray, chosen: np.ndarray, holders: np.ndarray) -> DataFrame:
    """(key, words): the words by rarity of lines whose set the bit map ``chosen`` has, in texts whose id the bit map ``holders`` has; other texts aren't read."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.flatnonzero(in_map(batch.column(0).to_numpy().view(U64), holders))
            for _, _, data, at in blocks(batch.column(1).take(pa.array(held)), TEXT_BYTES):
                _, _, words, of, line = line_sets(data, at, ranks)
                keys = keys_of(words, of)
                use = in_map(keys[:, 0], chosen) & (np.diff(of) >= LEAST_LINKED)
                _, one = np.unique(keys[:, 0], return_index=True)
                once = np.zeros(len(use), bool)
                once[one] = True
                use &= once
                rows = np.flatnonzero(use)
                flat = words[use[line]]
                sizes = np.concatenate([[0], np.cumsum(np.diff(of)[rows])])
                yield pa.RecordBatch.from_arrays([binary_array(keys[rows].ravel(), np.arange(len(rows) + 1) * 2), binary_array(flat, sizes)], ["key", "words"])

    return texts.mapInArrow(go, "key binary, words binary")


def marked(words: np.ndarray, of: np.ndarray, marks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set, place and number of blocks of the marked words in the sets' prefixes; set i has words[of[i]:of[i + 1]] and marks[i]."""
    n = prefix_length(np.diff(of))
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    flat, k = marks.flatten(), pc.list_value_length(marks).to_numpy(zero_copy_only=False).astype(np.int64)
    word, many = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
    kinds, code = np.unique(word, return_inverse=True)
    held = np.repeat(np.arange(len(k)), k) * len(kinds) + code
    order = np.argsort(held)
    held, many = held[order], many[order]
    head = words[of[row] + place].view(np.int64)
    found = np.minimum(np.searchsorted(kinds, head), max(len(kinds) - 1, 0))
    known = np.flatnonzero(kinds[found] == head) if len(kinds) else np.zeros(0, np.int64)
    row, place, wanted = row[known], place[known], row[known] * len(kinds) + found[known]
    at = np.minimum(np.searchsorted(held, wanted), max(len(held) - 1, 0))
    own = np.flatnonzero(held[at] == wanted) if len(held) else np.zeros(0, np.int64)
    return row[own], place[own], many[at[own]]


def spread(sets: DataFrame, tasks: int) -> DataFrame:
    """A row per set and task that a marked word of its prefix belongs to: (task, places of such words, their parts and the set's own blocks, key, words, id, line)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                flat, of = text_bytes(part.column(1))
                words, of = flat.view(U64), of // 8
                first = text_bytes(part.column(0))[0].view(U64)[::2]
                row, place, many = marked(words, of, part.column(4))
                block = (first[row] % many.astype(U64)).astype(np.int32)
                hit, piece = parts_of(block, many)
                row, place, block = row[hit], place[hit], block[hit]
                task = task_of(words[of[row] + place], piece, tasks)
                order = np.lexsort((task, row))
                row, task, place, piece, block = row[order], task[order], place[order], piece[order], block[order]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (task[1:] != task[:-1])])) if len(row) else np.zeros(0, np.int64)
                cut = np.append(new, len(row))
                lists = [binary_array(x, cut) for x in (place.astype(np.int32), piece, block)]
                yield pa.RecordBatch.from_arrays([pa.array(task[new]), *lists, *part.take(pa.array(row[new])).columns[:4]], ["task", "places", "parts", "owns", "key", "words", "id", "line"])

    return sets.select("key", "words", "id", "line", "marks").mapInArrow(go, "task int, places binary, parts binary, owns binary, key binary, words binary, id long, line long")


def linked_within(lists: list[np.ndarray], at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (rows, columns, links as a boolean matrix) of a word's lists: pairs, each once, whose first common word this is; ``at`` is its place in each list."""
    g = len(lists)
    if g <= 16:
        # with heads apart, sets share at most what begins at the places; sets are only made for pairs that this and their heads leave
        size, rest = [len(x) for x in lists], [len(x) - k for x, k in zip(lists, at.tolist(), strict=True)]
        pairs = [(i, j) for i in range(g) for j in range(i) if (OF + SIMILAR) * min(rest[i], rest[j]) >= SIMILAR * (size[i] + size[j])]
        if pairs:
            heads = [frozenset(x[:k].tolist()) for x, k in zip(lists, at.tolist(), strict=True)]
            pairs = [(i, j) for i, j in pairs if heads[i].isdisjoint(heads[j])]
        if pairs:
            sets = {i: frozenset(lists[i].tolist()) for i in {i for pair in pairs for i in pair}}
            close = np.zeros((g, g), bool)
            for i, j in pairs:
                close[i, j] = OF * (both := len(sets[i] & sets[j])) >= SIMILAR * (size[i] + size[j] - both)
            if close.any():
                yield np.arange(g), np.arange(g), close
        return
    sides = _sides(np.asarray([len(x) for x in lists], np.int64))
    for a, left in enumerate(sides):
        for right in sides[: a + 1]:
            kinds = np.unique(np.concatenate([lists[i] for i in (left if left is right else np.concatenate([left, right]))]))
            ours = _Side(lists, left, at, kinds)
            theirs = ours if left is right else _Side(lists, right, at, kinds)
            both, heads = np.zeros((2, len(left), len(right)), np.float32)
            for low in range(0, len(kinds), COLUMNS):
                m, h = ours.matrices(low)
                n, k = (m, h) if theirs is ours else theirs.matrices(low)
                both += m @ n.T
                heads += h @ k.T
            sizes = ours.size[:, None] + theirs.size[None, :] - both
            yield left, right, (OF * both >= SIMILAR * sizes) & (heads == 0) & (left[:, None] > right[None, :])


#: Lists and words of a side of a comparison, and columns of its matrices: a matrix has 16 MB at most.
SIDE_LISTS, SIDE_WORDS, COLUMNS = 512, 1 << 20, 1 << 13


def _sides(size: np.ndarray) -> list[np.ndarray]:
    """Consecutive lists of at most SIDE_LISTS lists and SIDE_WORDS words, or one longer list."""
    out, low = [], 0
    ends = np.cumsum(size)
    while low < len(size):
        high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SIDE_WORDS, "right"))
        high = min(max(high, low + 1), low + SIDE_LISTS)
        out.append(np.arange(low, high))
        low = high
    return out


class _Side:
    """Lists as rows of 0 and 1 over the columns ``kinds``; ``heads`` are their words before a place."""

    def __init__(self, lists: list[np.ndarray], side: np.ndarray, at: np.ndarray, kinds: np.ndarray):
        self.size = np.asarray([len(lists[i]) for i in side], np.int64)
        row = np.repeat(np.arange(len(side), dtype=np.int32), self.size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        column = np.searchsorted(kinds, np.concatenate([lists[i] for i in side])).astype(np.int32)
        order = np.argsort(column, kind="stable")
        self.row, self.column, self.head = row[order], column[order], (place < at[side][row])[order]

    def matrices(self, low: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.column, (low, low + COLUMNS))
        m, h = np.zeros((2, len(self.size), COLUMNS), np.float32)
        m[self.row[a:b], self.column[a:b] - low] = 1
        h[self.row[a:b], self.column[a:b] - low] = self.head[a:b]
        return m, h


def join_links(sets: DataFrame, tasks: int) -> DataFrame:
    """(key, n_links, linked): per class the number of linked classes and the earliest line of any of them."""

    def go(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, U64) for x in table["words"].to_pylist()]
        places = [np.frombuffer(x, np.int32) for x in table["places"].to_pylist()]
        row = np.repeat(np.arange(len(lists)), [len(x) for x in places])
        at = np.concatenate(places) if places else np.zeros(0, np.int32)
        part = np.frombuffer(b"".join(table["parts"].to_pylist()), np.int64)
        word = np.concatenate([x[k] for x, k in zip(lists, places, strict=True)]) if lists else np.zeros(0, U64)
        own = np.frombuffer(b"".join(table["owns"].to_pylist()), np.int32)
        order = np.lexsort((part, word))
        word, part, own, row, at = word[order], part[order], own[order], row[order], at[order]
        cuts = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (part[1:] != part[:-1]), [True]])) if len(word) else np.zeros(1, np.int64)
        ids, lines = table["id"].to_numpy(), table["line"].to_numpy()
        by_age = np.lexsort((lines, ids))
        age = np.empty(len(lists), np.int64)
        age[by_age] = np.arange(len(lists))
        links, best = np.zeros(len(lists), np.int64), np.full(len(lists), len(lists))
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if high - low < 2:
                continue
            rows, apart = row[low:high], bool(part_apart(part[low]))
            sides = own[low:high]
            for i, j, close in linked_within([lists[r] for r in rows], at[low:high]):
                if apart:
                    close &= sides[i][:, None] != sides[j][None, :]
                for x, y, m in ((rows[i], rows[j], close), (rows[j], rows[i], close.T)):
                    links[x] += m.sum(1)
                    best[x] = np.minimum(best[x], np.where(m, age[y][None, :], len(lists)).min(1))
        some = np.flatnonzero(links)
        first = by_age[best[some]]
        return pa.table({"key": table["key"].combine_chunks().take(pa.array(some)), "links": pa.array(links[some]), "id": pa.array(ids[first]), "line": pa.array(lines[first])})

    met = spread(sets, tasks).groupBy("task").applyInArrow(go, "key binary, links long, id long, line long")
    return met.groupBy("key").agg(F.sum("links").alias("n_links"), F.min(F.struct("id", "line")).alias("linked"))


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: id, line (from 0), n_words (different ones), class_id and class_line (the earliest line with the same
    set; null without words), n_links (other sets linked with it), removed."""
    with small_batches(docs.sparkSession):
        return _duplicate_lines(docs, id_col, text_col)


def _duplicate_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = _texts(docs, id_col, text_col)
    every = materialise(lines_of(texts), "lines")
    lines = every.where("bucket is null").drop("bucket", "k")
    classes = materialise(lines.where("key is not null").groupBy("key").agg(F.min(F.struct("id", "line")).alias("first"), F.count(F.lit(1)).alias("k"), F.min("n").alias("n"), F.min("set").alias("set")), "classes")
    ranks = word_ranks(every)
    held = prefix_counts(texts, ranks)
    many = np.clip(-(-held // BLOCK), 1, MOST_BLOCKS)
    least = partitions(docs.sparkSession)
    found = flagged(texts, ranks, many, max(least, -(-int((held * many).sum()) // TASK_POSTINGS)))
    partners = materialise(classes.join(marks_of(found).hint("merge"), "set").select("key", "set", "n", "first", "marks", "copies"), "partners")
    holders = bloom(partners.select(F.col("first.id").alias("set")))  # a class is read where its first line stands
    words = sets_of(texts, ranks, bloom(partners), holders).groupBy("key").agg(F.min("words").alias("words"))
    known = words.join(partners.hint("merge"), "key").select("key", "words", "first.id", "first.line", "marks")
    size = partners.agg(F.coalesce(F.sum(F.col("copies") * F.col("n")), F.lit(0))).first()[0] * 8
    links = join_links(known, max(least, -(-int(size) // TASK_BYTES)))
    told = classes.join(links.hint("merge"), "key", "left").select("key", "k", "first", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce(F.col("linked") < F.col("first"), F.lit(False)).alias("late"))
    told = materialise(told.where("k > 1 OR n_links > 0"), "told")  # a line that is alone in its class, without links, tells all of it
    keyed = lines.where("key is not null")
    met = lookup(keyed, told, "key", "k", told.agg(F.sum("k")).first()[0] or 0, "left")
    here = F.struct("id", "line")
    met = met.withColumns({"first": F.coalesce("first", here), "n_links": F.coalesce("n_links", F.lit(0).cast("long")), "late": F.coalesce("late", F.lit(False))})
    out = met.select("id", "line", F.col("n").alias("n_words"), F.col("first.id").alias("class_id"), F.col("first.line").alias("class_line"), "n_links", (F.col("late") | (here != F.col("first"))).alias("removed"))
    none = F.lit(None).cast("long")
    out = out.unionByName(lines.where("key is null").select("id", "line", F.col("n").alias("n_words"), none.alias("class_id"), none.alias("class_line"), F.lit(0).cast("long").alias("n_links"), F.lit(False).alias("removed")))
    shown = out.withColumns({c: F.nullif(c, F.lit(NO_ID)) for c in ("id", "class_id")})
    return shown.withColumnRenamed("id", id_col)


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their removed lines, with the columns of ``docs``. A document all of whose lines go stays, with an empty text."""
    found = duplicate_lines(docs, id_col, text_col).where("removed").groupBy(F.col(id_col).alias("id")).agg(F.collect_set(F.col("line").cast("int")).alias("gone"))
    found = materialise(found, "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("id", F.col("row")[id_col].cast("long"))
    whole = F.col("row")[text_col]
    # array_except hashes, so the work is linear in a text's lines; the outer transform holds the split once
    others = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(lines, i))
    spare = F.transform(F.array(F.split(whole, "\n", -1)), others)[0]
    text = F.when(F.col("gone").isNull(), whole).otherwise(F.array_join(spare, "\n"))
    # rows without id keep all lines: they aren't joined, so that they can't make one hot key
    met = rows.where("id is not null").join(found.hint("merge"), "id", "left").unionByName(rows.where("id is null"), allowMissingColumns=True)
    return met.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
