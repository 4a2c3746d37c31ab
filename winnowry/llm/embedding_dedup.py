"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of a unit vector, are fitted independently; pairs of codewords are the cells of a grid.
Every vector lies in the cell of its nearest codewords and probes the cells with the smallest sums of distances, in
multi-sequence order. How many it probes is set on a bounded sample so that a pair at the threshold itself is met with
``TARGET_RECALL`` (pairs above it more often). Met pairs are verified by cosine in double precision.

The sample (``SAMPLE`` vectors of each length, by a hash of the id) serves only codebooks and the number of probes; every
vector is indexed. Vectors of different lengths can't be linked, so each length has an index of its own. Equal vectors form
a class that is compared once. Cells are dealt into blocks, so a task holds at most ``BLOCK`` members and ``BLOCK`` queries
whatever a cell holds; a task returns counts per vector and a spanning forest of its links, never the links themselves.
A grid has about 128 vectors a cell and at most 2^20 cells (beyond 10^8 vectors cells grow); their sizes are broadcast.
A vector travels once to each cell that it probes.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component link with nothing; components
count in the precision they're given in; rows that repeat a vector count as other vectors; a row
without id gets the links of an equal vector with one, if there is any; extra columns are ignored;
an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components, forest
from ._store import materialise

THRESHOLD = 0.9
TARGET_RECALL = 0.98
SAMPLE = 8192
CALIBRATE = 1024
BLOCK = 2048
MAX_CODEWORDS = 1024


@dataclass
class Grid:
    left: np.ndarray
    right: np.ndarray
    probes: int

    @property
    def size(self) -> int:
        return len(self.left)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codewords(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = distances(x, centres).argmin(1)
        many = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            total = np.bincount(near, x[:, d], k)
            centres[:, d] = np.where(many > 0, total / np.maximum(many, 1), centres[:, d])
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)


def halves(x: np.ndarray, grid: Grid) -> tuple[np.ndarray, np.ndarray]:
    cut = grid.left.shape[1]
    return distances(x[:, :cut], grid.left), distances(second_half(x, cut), grid.right)


def second_half(x: np.ndarray, cut: int) -> np.ndarray:
    """The components from ``cut`` on; of vectors of one component, a 0."""
    return x[:, cut:] if x.shape[1] > cut else np.zeros((len(x), 1))


def visit(x: np.ndarray, grid: Grid) -> np.ndarray:
    """The ``probes`` cells with the smallest sums of half distances, nearest first. Only index pairs with (i + 1)(j + 1) <= probes in the two sorted lists can be among them."""
    k, t = grid.size, min(grid.probes, grid.size**2)
    i, j = np.array([(i, j) for i in range(min(k, t)) for j in range(min(k, t // (i + 1)))]).T
    out = np.empty((len(x), t), np.int64)
    for low in range(0, len(x), 1024):
        a, b = halves(x[low : low + 1024], grid)
        by_a, by_b = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        sums = np.take_along_axis(a, by_a, 1)[:, i] + np.take_along_axis(b, by_b, 1)[:, j]
        first = sums.argsort(1, kind="stable")[:, :t]
        out[low : low + 1024] = np.take_along_axis(by_a[:, i], first, 1) * k + np.take_along_axis(by_b[:, j], first, 1)
    return out


def fit(x: np.ndarray, n: int, threshold: float = THRESHOLD, target: float = TARGET_RECALL, seed: int = 3) -> Grid:
    """Codebooks for n vectors of which x is a sample, and the number of probes with which a pair at the threshold is met with the target's chance."""
    rng = np.random.default_rng(seed)
    x = unit(x.astype(float))
    k = int(np.clip(round(np.sqrt(n / 128)), 1, max(1, min(MAX_CODEWORDS, len(x) // 8))))
    cut = max(1, x.shape[1] // 2)
    grid = Grid(codewords(x[:, :cut], k, rng), codewords(second_half(x, cut), k, rng), k * k)
    some = x[:CALIBRATE]
    noise = rng.normal(size=some.shape)
    noise = noise - (noise * some).sum(1, keepdims=True) * some
    other = threshold * some + np.sqrt(1 - threshold**2) * noise / np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
    sides = [halves(v, grid) for v in (some, other)]
    cells = [(a.argmin(1), b.argmin(1)) for a, b in sides]
    ranks = []
    for s, (a, b) in enumerate(sides):  # how many cells are nearer to one of the pair than the other's cell is
        (i, j), b = cells[1 - s], np.sort(b, 1)
        seen = np.empty(len(a), np.int64)
        for r in range(len(a)):
            limit = a[r, i[r]] + sides[s][1][r, j[r]]
            seen[r] = np.searchsorted(b[r], limit - a[r], "left").sum()
        ranks.append(seen)
    ranks = [np.minimum(*ranks)]
    grid.probes = int(np.quantile(np.concatenate(ranks), target, method="higher")) + 1
    return grid


def local_links(x: np.ndarray, y: np.ndarray, id_x: np.ndarray, id_y: np.ndarray, threshold: float) -> np.ndarray:
    close = x @ y.T >= threshold
    close &= id_x[:, None] != id_y[None, :]
    return close


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of ``size`` components, kept as 4 or 8 bytes each."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * size * len(column) else np.float64).reshape(-1, size).astype(float)


def _cells(valid: DataFrame, grid: Grid, size: int) -> DataFrame:
    """(id, weight, vector, cells): the cells that each vector probes; the first is its own."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                seen = visit(unit(_vectors(batch.column(2), size)), grid)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(seen) + 1, dtype=np.int32) * seen.shape[1]), pa.array(seen.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, cells], ["id", "weight", "vector", "cells"])

    return valid.select("id", "weight", "vector").mapInArrow(go, "id long, weight long, vector binary, cells array<int>")


def _packed(rows: DataFrame, vec_col: str) -> DataFrame:
    """(id, vector, length): the components as bytes, of 4 bytes each where the column holds floats, else of 8; null where the vector can't be compared."""
    kind = "float" if rows.schema[vec_col].dataType.elementType.simpleString() == "float" else "double"
    wide = pa.float32() if kind == "float" else pa.float64()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, lengths = [], []
            for v in batch.column(1):
                x = None if v.values is None else v.values.cast(wide)
                if x is None or x.null_count or not len(x):
                    ok = None
                else:
                    x = np.ascontiguousarray(x.to_numpy(zero_copy_only=False))
                    ok = x.tobytes() if np.isfinite(x).all() and x.any() else None
                raw.append(ok)
                lengths.append(None if ok is None else len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(lengths, pa.int32())], ["id", "vector", "length"])

    return rows.select(F.col("id"), F.col(vec_col).cast(f"array<{kind}>").alias("v")).mapInArrow(go, "id long, vector binary, length int")


def near_duplicate_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """One row per input row: id, n_links (other rows linked directly), component_id (smallest id reachable), kept (id = component_id)."""
    every = materialise(_packed(rows.withColumn("id", F.col(id_col).cast("long")), vec_col), "vectors")
    lengths = every.where("length is not null and id is not null").groupBy("length").count().where("count > 1").orderBy("length").collect()
    if not lengths:
        return every.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    known = [_of_length(every.where((F.col("length") == r["length"]) & F.col("id").isNotNull()), r["length"], threshold, target) for r in lengths]
    out = every.join(reduce(DataFrame.unionByName, known).hint("merge"), ["length", "vector"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _of_length(some: DataFrame, size: int, threshold: float, target: float) -> DataFrame:
    """(length, vector, n_links, component_id) of each different vector of one length."""
    classes = materialise(some.groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")), "classes")
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("id", F.lit("grid")), "id").select("vector").limit(SAMPLE).toPandas()["vector"]
    grid = fit(_vectors(pa.array(map(bytes, sample), pa.binary()), size), n, threshold, target)
    placed = materialise(_cells(classes, grid, size), "placed")
    queries = placed.select("id", "weight", "vector", F.col("cells")[0].alias("own"), F.explode("cells").alias("cell"))
    members = placed.withColumn("cell", F.col("cells")[0])
    held = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n_members"))
    asked = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n_queries"))
    blocks = F.broadcast(held.join(asked, "cell").select("cell", F.ceil(F.col("n_members") / BLOCK).cast("int").alias("m"), F.ceil(F.col("n_queries") / BLOCK).cast("int").alias("q")))
    key = ["cell", "m_block", "q_block"]
    deal = lambda of, many, salt: F.pmod(F.xxhash64(of, F.lit(salt)), F.col(many)).cast("int")
    left = queries.join(blocks, "cell").withColumn("q_block", deal("id", "q", "query")).withColumn("m_block", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select(*key, "id", "weight", "vector", "own")
    right = members.join(blocks, "cell").withColumn("m_block", deal("id", "m", "member")).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q") - 1))).select(*key, "id", "weight", "vector", "cells").toDF("r_cell", "r_m", "r_q", "r_id", "r_weight", "r_vector", "r_cells")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        kinds, first, second = [], [], []
        if a.num_rows and b.num_rows:
            x, y = unit(_vectors(a["vector"], size)), unit(_vectors(b["r_vector"], size))
            id_x, id_y = a["id"].to_numpy(), b["r_id"].to_numpy()
            w_x, w_y = a["weight"].to_numpy(), b["r_weight"].to_numpy()
            own = a["own"].to_numpy()
            probes = b["r_cells"].combine_chunks().flatten().to_numpy().reshape(len(id_y), -1)
            for low in range(0, len(id_x), 512):
                at = slice(low, low + 512)
                close = local_links(x[at], y, id_x[at], id_y, threshold)
                if not close.any():
                    continue
                u, v = forest(close, id_x[at], id_y)
                mutual = np.zeros_like(close)  # where y probes the cell of x too, y counts x in that cell's task
                for o in np.unique(own[at]):
                    mutual[np.ix_(own[at] == o, (probes == o).any(1))] = True
                to_x, to_y = close @ w_y, w_x[at] @ (close & ~mutual)
                for ids, counts in ((id_x[at], to_x), (id_y, to_y)):
                    some = np.flatnonzero(counts)
                    kinds.append(np.zeros(len(some), np.int32))
                    first.append(ids[some])
                    second.append(counts[some].astype(np.int64))
                kinds.append(np.ones(len(u), np.int32))
                first.append(u)
                second.append(v)
        join = lambda parts, t: pa.array(np.concatenate(parts) if parts else np.zeros(0, t), pa.from_numpy_dtype(t))
        return pa.table({"kind": join(kinds, np.int32), "a": join(first, np.int64), "b": join(second, np.int64)})

    met = materialise(left.groupBy(*key).cogroup(right.groupBy("r_cell", "r_m", "r_q")).applyInArrow(meet, "kind int, a long, b long"), "met")
    counts = met.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    labels = components(met.where("kind = 1 and a != b").select(F.col("a").alias("u"), F.col("b").alias("v")))
    known = classes.join(counts.hint("merge"), "id", "left").join(labels.hint("merge"), "id", "left")
    return materialise(known.select(F.lit(size).alias("length"), "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "known")
