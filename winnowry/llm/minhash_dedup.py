"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct shingles of five words. Register i of its sketch is a truncated, exponentially
spaced minimum: floor(1 - log_b(x_i)), x_i being the smallest of the shingles' exponential hashes; registers of parts
merge by their maximum. The sketch is locality-sensitive: at similarity 0.75 two registers agree with chance 0.76.

1. Documents with the same set form a class, the vertex of all that follows.
2. Bands of register values are keys. Within a key every class is paired with the smallest one: as many pairs as rows.
   A few bands come first; of all bands only keys that then still hold more than one component are read on.
3. Registers of a pair give counts of greater, smaller and equal values; with the known set sizes they make a likelihood
   of the similarity. A pair goes on unless the threshold and all above it are far less likely than the best value.
   Pairs that go on are verified on full sets, first the likeliest of each class, then those between components.
4. Keys that still hold more than one component: members outside the key's largest component meet the others block by
   block, whatever their number. A block returns a spanning forest of the pairs that the likelihood doesn't give up, so
   rows grow with the members, not with the pairs. The trees of all blocks together are families.
5. A family's sets meet, block by block too, and every pair of different components is verified there by counting common
   shingles; a block returns the links that join components, at most one less than it has components.

What can be lost: a pair at the threshold shares no band with chance below 1e-6 (48 bands of 5), and the likelihood
(``GIVE_UP``, with ``LEAST_EQUAL`` before it, which is 6.5 deviations below the mean) gives it up with chance below 1e-7.
Sets are of 64-bit hashes of shingles (a polynomial modulo 2^64 of mixed word hashes, mixed again): two different shingles
of a pair of documents with 10^4 shingles each collide with chance below 1e-11, and one collision moves a similarity by
10^-4; classes are told apart by two 64-bit sums of mixed hashes and the size.

Defined results: a null or wordless text has an empty set, links with nothing and stands alone; a text of fewer words
than a shingle is one shingle; rows that repeat an id are rows of their own, and an id's component is that of its own
text; a row without id has the component of its text, null if no row of the component has an id; extra columns are
ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import LOWER_BYTES, SPACE, U64, Rolling, binary_array, blocks, mix, spans, tidy, words_per_row
from ._components import components, forest, joined
from ._store import materialise, small_batches

SHINGLE = 5
SIMILAR, OF = 75, 100
BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS
BASE, RATE = 1.1, 20.0
#: How much less likely (natural logarithm) the threshold has to be than the best similarity for a pair to be given up.
GIVE_UP = 14.0
#: Bands of the first round.
FIRST = 6
#: Registers that agree at least. At the threshold 182 of 240 do on average, with a deviation of 6.5.
LEAST_EQUAL = 140
#: Classes of a block when pairs are verified, and members and outside members of a key's block.
BLOCK = 1024
#: Bytes of sets that a family's block holds on average, at most.
BLOCK_BYTES = 8 << 20
#: Bytes of texts that are shingled together.
TEXT_BYTES = 1 << 18
#: Bits of the map of needed sets: a fixed 2 MB, whatever the corpus. It only spares work, as false hits are dropped by a join.
MAP_BITS = 1 << 24
_RNG = np.random.default_rng(19)
_FLIP = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_ODD = _RNG.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_STEP = U64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's distinct shingles, sorted within the document, and where each document's begin."""
    starts, ends = spans(data, at, ~SPACE)
    words = Rolling(data, LOWER_BYTES)(starts, ends)
    of = words_per_row(starts, at)
    many = np.diff(of)
    n = len(words)
    if n >= size:
        long = words[: n - size + 1].copy()
        for k in range(1, size):
            long = long * _STEP + words[k : n - size + 1 + k]
        last = np.repeat(of[1:], many)[: n - size + 1]
        inside = np.arange(n - size + 1) + size <= last
        hashes, doc = mix(long[inside]), np.repeat(np.arange(len(many)), many)[: n - size + 1][inside]
    else:
        hashes, doc = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((many > 0) & (many < size))
    if len(short):
        whole = np.zeros(len(short), U64)
        for k in range(size - 1):
            there = many[short] > k
            whole[there] = whole[there] * _STEP + words[of[short[there]] + k]
        hashes, doc = np.concatenate([hashes, mix(whole + many[short].astype(U64))]), np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    if len(hashes):
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(many) + 1), "left")


def registers(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SetSketch registers, a row per document; of an empty set all are 0."""
    full = np.flatnonzero(np.diff(at))
    low = np.full((REGISTERS, len(at) - 1), 0xFFFFFFFF, np.uint32)
    short = (hashes >> U64(32)).astype(np.uint32)
    for i in range(REGISTERS):
        if len(full):
            low[i, full] = np.minimum.reduceat((short ^ _FLIP[i]) * _ODD[i], at[full])
    smallest = -np.log1p(-(low.T + 0.5) / 2.0**32) / RATE
    values = np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, 255).astype(np.uint8)
    values[np.diff(at) == 0] = 0
    return values


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


_GRID = np.linspace(0, 1, 201)


def likelihoods(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Logarithm of the likelihood of each similarity on the grid, a row per pair, from which registers are greater, smaller or equal and the set sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    share_a = (n_a / (n_a + n_b))[:, None]
    share_b = 1 - share_a

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = chance(share_a - share_b * _GRID), chance(share_b - share_a * _GRID)
    tiny = 1e-9
    out = more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + (a.shape[1] - more - less) * np.log(np.maximum(1 - up - down, tiny))
    possible = _GRID <= np.minimum(n_a / n_b, n_b / n_a)[:, None] + 1 / (len(_GRID) - 1)
    return np.where(possible, out, -np.inf)


SKETCH = "id long, t long, n long, h1 long, h2 long, regs binary"


def set_sums(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set: sums of its elements, mixed in two ways."""
    sums = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([[U64(0)], np.cumsum(mix(hashes ^ U64(salt)), dtype=U64)])
        sums.append((total[of[1:]] - total[of[:-1]]).view(np.int64))
    return sums[0], sums[1]


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, a hash of its text, the size of its set, two hashes of the set, its registers."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for low, high, data, at in blocks(batch.column(2), TEXT_BYTES):
                hashes, of = shingle_sets(data, at)
                h1, h2 = set_sums(hashes, of)
                rows = binary_array(registers(hashes, of).ravel(), np.arange(high - low + 1) * REGISTERS)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(low, high - low) for k in (0, 1)), pa.array(np.diff(of)), pa.array(h1), pa.array(h2), rows], ["id", "t", "n", "h1", "h2", "regs"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).mapInArrow(go, SKETCH)


def _map_of(need: DataFrame) -> np.ndarray:
    """A bit map of fixed size with a bit for each t."""
    bit = F.pmod("t", F.lit(MAP_BITS))
    rows = need.select(F.shiftright(bit, 5).cast("int").alias("w"), F.expr(f"shiftleft(1L, CAST(pmod(t, {MAP_BITS}) & 31 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(MAP_BITS // 32, np.uint32)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).astype(np.uint32)
    return out


def sets_of(docs: DataFrame, need: DataFrame) -> DataFrame:
    """(v, elements): the sorted 64-bit hashes of the shingles of the needed classes. docs: text; need: v, t, h1, h2, a written table; t is the hash of one
    of the class's texts. Other texts are dropped in the scan by their hash, so that few are shingled again and only sets that may be needed are shuffled."""
    chosen = _map_of(need)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            t = batch.column(0).to_numpy()
            bit = t & (MAP_BITS - 1)
            use = np.flatnonzero(chosen[bit >> 5] >> (bit & 31).astype(np.uint32) & np.uint32(1))
            use = use[np.unique(t[use], return_index=True)[1]]
            for _, _, data, at in blocks(batch.column(1).take(pa.array(use)), TEXT_BYTES):
                hashes, of = shingle_sets(data, at)
                h1, h2 = set_sums(hashes, of)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), binary_array(hashes, of)], ["h1", "h2", "elements"])

    found = docs.select(F.xxhash64("text").alias("t"), "text").mapInArrow(go, "h1 long, h2 long, elements binary").groupBy("h1", "h2").agg(F.first("elements").alias("elements"))
    return found.join(need.select("v", "h1", "h2").hint("merge"), ["h1", "h2"]).select("v", "elements")


def _matrix(column: pa.Array, dtype=np.uint8) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def bands_of(classes: DataFrame, first: int = 0, last: int = BANDS) -> DataFrame:
    """(key, band, v, c): a row per band of each class (v, c, regs)."""
    weights = np.random.default_rng(23).integers(1, 1 << 62, (BANDS, ROWS), dtype=U64) * U64(2) + U64(1)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                regs = _matrix(part.column(2)).reshape(-1, BANDS, ROWS).astype(U64)
                keys = mix((mix(regs + U64(1)) * weights).sum(2, dtype=U64) + np.arange(BANDS, dtype=U64))[:, first:last]
                band = np.tile(np.arange(first, last, dtype=np.int8), len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(band), *[pa.array(np.repeat(part.column(k).to_numpy(), last - first)) for k in (0, 1)]], ["key", "band", "v", "c"])

    return classes.select("v", "c", "regs").mapInArrow(go, "key long, band byte, v long, c long")


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of registers the likelihood doesn't give up, and the likeliest similarities (0 where too few registers agree to look further)."""
    keep, likely = np.zeros(len(a), bool), np.zeros(len(a))
    at = int(np.searchsorted(_GRID, SIMILAR / OF - 1e-9))
    for low in range(0, len(a), 512):
        x, y = a[low : low + 512], b[low : low + 512]
        some = np.flatnonzero((x == y).sum(1) >= LEAST_EQUAL)
        if len(some):
            value = likelihoods(x[some], y[some], n_a[low + some].astype(float), n_b[low + some].astype(float))
            keep[low + some] = value[:, at:].max(1) >= value.max(1) - GIVE_UP
            likely[low + some] = _GRID[value.argmax(1)]
    return keep, likely


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b, c_a, c_b) that the likelihood doesn't give up, with the likeliest similarity."""
    side = classes.select("v", "n", "regs")
    both = pairs.join(side.toDF("a", "n_a", "regs_a").hint("merge"), "a").join(side.toDF("b", "n_b", "regs_b").hint("merge"), "b")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                *names, n_a, n_b, x, y = part.columns
                keep, likely = plausible(_matrix(x), _matrix(y), n_a.to_numpy(), n_b.to_numpy())
                yield pa.RecordBatch.from_arrays([*names, pa.array(likely)], ["a", "b", "c_a", "c_b", "likely"]).filter(pa.array(keep))

    return both.select("a", "b", "c_a", "c_b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(go, "a long, b long, c_a long, c_b long, likely double")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The components (u, v) of those of the pairs (a, b, c_a, c_b), a written table, whose full sets reach the threshold. Classes are dealt into blocks; a task has the pairs of two blocks and the sets they need."""
    need = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()
    need = materialise(need.join(classes.select("v", "t", "h1", "h2").hint("merge"), "v"), "need")
    many = max(1, -(-need.count() // BLOCK))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(many)).cast("int")
    pairs = pairs.select("a", "b", "c_a", "c_b").withColumns({"i": block("a"), "j": block("b")})
    sent = pairs.select("i", "j", F.col("a").alias("v")).union(pairs.select("i", "j", "b")).distinct()
    sent = sent.join(sets_of(docs, need).hint("merge"), "v").select(F.col("i").alias("i2"), F.col("j").alias("j2"), "v", "elements")

    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        held = {k: np.frombuffer(v, U64) for k, v in zip(right["v"].to_pylist(), right["elements"].to_pylist(), strict=True)}
        keep = []
        for a, b in zip(left["a"].to_pylist(), left["b"].to_pylist(), strict=True):
            x, y = held[a], held[b]
            if OF * min(len(x), len(y)) < SIMILAR * max(len(x), len(y)):
                keep.append(False)
                continue
            together = np.concatenate([x, y])
            together.sort()
            shared = int(np.count_nonzero(together[1:] == together[:-1]))
            keep.append(OF * shared >= SIMILAR * (len(x) + len(y) - shared))
        return left.select(["c_a", "c_b"]).rename_columns(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.groupBy("i", "j").cogroup(sent.groupBy("i2", "j2")).applyInArrow(go, "u long, v long")


def labelled(rows: DataFrame, labels: DataFrame, column: str, to: str) -> DataFrame:
    """Adds the component of a class; one without links is its own component."""
    return rows.join(labels.select(F.col("id").alias(column), F.col("component").alias("_c")).hint("merge"), column, "left").withColumn(to, F.coalesce("_c", column)).drop("_c")


def star_pairs(bands: DataFrame) -> DataFrame:
    """Each member of a key with the key's smallest member, where their components differ: distinct pairs (a, b), b < a,
    with their components c_a and c_b, dealt by a: what follows joins there first.
    The table of bands is read twice; both sides of the join are shuffled, so a hot key can be split."""
    centres = bands.groupBy("key").agg(F.min(F.struct("v", "c")).alias("m"), F.min("c").alias("low"), F.max("c").alias("high")).where("low != high")
    centres = materialise(centres.select("key", F.col("m.v").alias("b"), F.col("m.c").alias("c_b")), "centres")
    return bands.join(centres.hint("merge"), "key").where("c != c_b").select(F.col("v").alias("a"), "b", F.col("c").alias("c_a"), "c_b").repartition("a").distinct()


def _dealt(many: str, salt: str) -> F.Column:
    return F.pmod(F.xxhash64("v", F.lit(salt)), F.col(many)).cast("int")


def _every_of(many: str) -> F.Column:
    return F.explode(F.sequence(F.lit(0), F.col(many) - 1))


def leftover_forest(bands: DataFrame, detail: DataFrame) -> DataFrame:
    """What stars didn't try: in keys that hold several components, members outside the key's largest one with all members of other components.
    bands: key, band, v, c; detail: sizes and registers by v. Returns links (u, v) of a spanning forest of each block's pairs that the likelihood
    doesn't give up. A pair that shares several bands counts where the first of them is."""
    parts = bands.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k"))
    mixed = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("k").alias("all"), F.max(F.struct("k", "c")).alias("top")).where("parts > 1 and all > 2")
    mixed = materialise(mixed.select("key", F.col("top.c").alias("main"), "all", (F.col("all") - F.col("top.k")).alias("outside")), "mixed")
    tasks = F.ceil(F.col("outside") / BLOCK).cast("int").alias("u_tasks"), F.ceil(F.col("all") / (4 * BLOCK)).cast("int").alias("m_tasks")
    members = bands.join(mixed.select("key", "main", *tasks).hint("merge"), "key").join(detail.hint("merge"), "v")
    members = materialise(members, "members")
    outside = members.where("c != main").withColumn("u", _dealt("u_tasks", "u")).withColumn("m", _every_of("m_tasks")).select("key", "u", "m", "band", "v", "c", "n", "regs")
    others = members.withColumn("m", _dealt("m_tasks", "m")).withColumn("u", _every_of("u_tasks")).select("key", "u", "m", "v", "c", "main", "n", "regs").toDF("key2", "u2", "m2", "v", "c", "main", "n", "regs")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        x, y = _matrix(left["regs"].combine_chunks()), _matrix(right["regs"].combine_chunks())
        id_x, id_y, c_x, c_y, n_x, n_y = (t[k].to_numpy() for k in ("v", "c", "n") for t in (left, right))
        main, band = c_y == right["main"].to_numpy(), left["band"][0].as_py()
        close = np.zeros((len(id_x), len(id_y)), bool)
        for k in range(len(id_x)):
            some = np.flatnonzero((c_y != c_x[k]) & (main | (id_y < id_x[k])) & (OF * np.minimum(n_y, n_x[k]) >= SIMILAR * np.maximum(n_y, n_x[k])))
            for low in range(0, len(some), 512):
                part = some[low : low + 512]
                same = y[part] == x[k]
                part = part[(same.sum(1) >= LEAST_EQUAL) & (same.reshape(len(part), BANDS, ROWS).all(2).argmax(1) == band)]
                if len(part):
                    close[k, part] = plausible(np.broadcast_to(x[k], (len(part), x.shape[1])), y[part], np.full(len(part), n_x[k]), n_y[part])[0]
        u, v = forest(close, id_x, id_y)
        return pa.table({"u": u, "v": v})

    return outside.groupBy("key", "u", "m").cogroup(others.groupBy("key2", "u2", "m2")).applyInArrow(meet, "u long, v long").where("u != v")


def joining(v: np.ndarray, c: np.ndarray, block: np.ndarray, sets: list[np.ndarray], main: int) -> list[tuple[int, int]]:
    """Verified links between different components, enough of them to join what they join. Pairs within one block count only where no other block is at hand."""
    parent = {k: k for k in c.tolist()}

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    kinds, number = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(number, kind="stable")
    holder, begin = owner[order], np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(kinds)))])
    at = np.concatenate([[0], np.cumsum(n)])
    alone, out = block.min() == block.max(), []
    for x in np.flatnonzero(c != main).tolist():
        fit = (c != c[x]) & ((c == main) | (v < v[x])) & (OF * np.minimum(n, n[x]) >= SIMILAR * np.maximum(n, n[x]))
        if not alone:
            fit &= block != block[x]
        if not fit.any():
            continue
        mine = number[at[x] : at[x + 1]]
        many = begin[mine + 1] - begin[mine]
        place = np.repeat(begin[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())
        both = np.bincount(holder[place], minlength=len(sets))
        linked = np.flatnonzero(fit & (OF * both >= SIMILAR * (n + n[x] - both)))
        if len(linked):
            kinds_c, first = np.unique(c[linked], return_index=True)
            for other, y in zip(kinds_c.tolist(), linked[first].tolist(), strict=True):
                a, b = root(int(c[x])), root(other)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((int(v[x]), int(v[y])))
    return out


def family_links(families: DataFrame, labels: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """families: (id, component) of the plausible pairs' trees. Components (u, v) that verified links join, of all pairs within families."""
    members = families.select(F.col("id").alias("v"), F.col("component").alias("family"))
    need = materialise(members.join(classes.select("v", "t", "n", "h1", "h2").hint("merge"), "v"), "need")
    held = materialise(labelled(need.select("v", "n", "family"), labels, "v", "c"), "held")
    of_c = held.groupBy("family", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("bytes"))
    sizes = of_c.groupBy("family").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("k"), (8 * F.sum("bytes")).alias("bytes"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    sizes = materialise(sizes.select("family", F.col("top.c").alias("main"), F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("q")), "families")
    dealt = held.join(sizes.hint("merge"), "family").withColumn("block", _dealt("q", "family")).join(sets_of(docs, need).hint("merge"), "v")
    dealt = materialise(dealt.select("family", "main", "q", "block", "v", "c", "elements"), "dealt")
    met = dealt.withColumn("other", _every_of("q")).select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "main", "block", "v", "c", "elements")

    def go(table: pa.Table) -> pa.Table:
        block = table["block"].to_numpy()
        links: list[tuple[int, int]] = []
        if table["i"][0] == table["j"][0] or block.min() != block.max():
            sets = [np.frombuffer(x.as_buffer(), U64) for x in table["elements"]]
            links = joining(table["v"].to_numpy(), table["c"].to_numpy(), block, sets, table["main"][0].as_py())
        of = dict(zip(table["v"].to_pylist(), table["c"].to_pylist(), strict=True)) if links else {}
        return pa.table({"u": pa.array([of[a] for a, _ in links], pa.int64()), "v": pa.array([of[b] for _, b in links], pa.int64())})

    return met.groupBy("family", "i", "j").applyInArrow(go, "u long, v long")


def classes_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' sketches without registers (id, t, n, h1, h2), the classes of equal sets (v, n, h1, h2, regs), and (id, component) of those with links; all written."""
    with small_batches(docs.sparkSession):
        return _classes_of(docs, id_col, text_col)


def _classes_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    texts = docs.select(F.col(text_col).alias("text"))
    sketched = materialise(sketches(docs, id_col, text_col), "sketches")
    classes = sketched.where("n > 0").groupBy("n", "h1", "h2").agg(F.first("t").alias("t"), F.first("regs").alias("regs")).withColumn("v", F.monotonically_increasing_id())
    classes = materialise(classes, "classes")
    tried = estimated(star_pairs(materialise(bands_of(classes.withColumn("c", F.col("v")), 0, FIRST), "bands")), classes)
    best = tried.groupBy("a").agg(F.max_by("b", F.struct("likely", -F.col("b"))).alias("b"))
    best = materialise(best.select("a", "b", F.col("a").alias("c_a"), F.col("b").alias("c_b")), "best")
    labels = components(verified(best, texts, classes))
    # of all bands, those rows whose key still holds more than one component
    bands = bands_of(labelled(classes, labels, "v", "c"))
    open_ = bands.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select("key")
    bands = materialise(bands.join(materialise(open_, "open").hint("merge"), "key", "left_semi"), "bands")
    pairs = materialise(estimated(star_pairs(bands), classes).drop("likely").join(best.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), "pairs")
    labels = joined(labels, verified(pairs, texts, classes))
    bands = materialise(labelled(bands.drop("c"), labels, "v", "c"), "bands")
    families = components(leftover_forest(bands, classes.select("v", "n", "regs")))
    if not families.isEmpty():
        labels = joined(labels, family_links(families, labels, texts, classes))
    return sketched.drop("regs"), classes, labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links, itself included), kept (the component's smallest id)."""
    return _told(*classes_of(docs, id_col, text_col)).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _told(sketched: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """sketched with its component: its label (null for an empty set) and its smallest id. Ids are reduced by set, then by label, before they're joined, so large groups combine."""
    same = ["n", "h1", "h2"]
    least = sketched.where("n > 0").groupBy(*same).agg(F.min("id").alias("id"))
    named = materialise(labelled(classes.select("v", *same), labels, "v", "label").join(least.hint("merge"), same), "named")
    smallest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    found = materialise(named.select(*same, "label").join(smallest.hint("merge"), "label"), "found")
    met = sketched.join(found.hint("merge"), same, "left")
    return met.withColumn("component_id", F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component_id")))


#: A character of a word.
_OF_WORD = "[^\\x20\\x09-\\x0D]"


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, all columns: the one with the smallest id (null ids last); of rows that repeat an id, one whose set has the
    smallest hash, and of rows that repeat a set too, any one. Documents with an empty set all stay. Rows don't pass through Python: those that repeat
    an id are told apart by the 64-bit hashes of their texts."""
    told = _told(*classes_of(docs, id_col, text_col))
    first = told.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2", "t")).alias("m"))
    same = ["none", "id", "t"]  # without nulls, so that rows are dealt once for both the group and the join
    keep = materialise(first.select("m.none", F.coalesce("m.id", F.lit(0)).alias("id"), "m.t"), "keep")
    names = docs.columns
    id_, row = F.col(f"`{id_col}`").cast("long"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    held = docs.select(id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("id"), F.xxhash64(text_col).alias("t"), F.coalesce(F.col(text_col).rlike(_OF_WORD), F.lit(False)).alias("words"), row.alias("row"))
    one = held.where("words").groupBy(*same).agg(F.first("row").alias("row")).join(keep.hint("merge"), same, "left_semi").select("row")
    return one.unionByName(held.where("not words").select("row")).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])
