"""Connected components of links that stay distributed: alternating large and small stars.

A small star hooks every vertex's smaller neighbours to the smallest one, a large star its larger neighbours; the number of
links never grows and the rounds needed grow with the logarithm of the size. Tasks contract the links at hand to spanning
trees before and after each shuffle, so a vertex goes up at most once from each run of links and a small star is one
shuffle without hot keys. In large stars vertices with very many links are joined by broadcast of their few rows (see
``lookup``). The counts that a large star needs anyway tell when all trees are stars. Each step is written to the shared folder.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import lookup, materialise

#: Links that a task contracts together.
RUN = 1 << 20
#: Rows of a task on average, at most, and tasks at least.
TASK_LINKS, LEAST_TASKS = 1 << 17, 12


def trees(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the same components: every vertex but a component's smallest with that one."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(ids))
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    up = np.flatnonzero(label != np.arange(len(ids)))
    return ids[up], ids[label[up]]


def contracted(links: DataFrame, whole: bool = False) -> DataFrame:
    """Links (u, v), v < u, that join what the given ones join: trees of runs of about RUN links. whole: links are sorted by u, and a run has all of a u."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), np.int64)
        waiting: list[np.ndarray] = []

        def told(x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in trees(x[0], x[1])], ["u", "v"])

        for batch in batches:
            waiting.append(np.stack([batch.column(k).to_numpy() for k in (0, 1)]))
            if held.shape[1] + sum(x.shape[1] for x in waiting) >= RUN:
                held, waiting = np.concatenate([held, *waiting], 1), []
                cut = int(np.searchsorted(held[0], held[0, -1])) if whole else held.shape[1]
                if cut:
                    yield told(held[:, :cut])
                    held = held[:, cut:]
        held = np.concatenate([held, *waiting], 1)
        if held.shape[1]:
            yield told(held)

    return links.mapInArrow(go, "u long, v long")


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    """df in tasks of about TASK_LINKS rows, LEAST_TASKS at least: links get fewer from round to round, shuffle partitions don't."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // TASK_LINKS)))


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    dealt = _dealt(contracted(_dealt(links, rows)).repartition("u").sortWithinPartitions("u"), rows)
    return materialise(contracted(dealt, whole=True), "links")


def components(links: DataFrame) -> DataFrame:
    """links: two id columns u and v. Returns (id, component) for every id that has a link, written; component is the smallest id reachable."""
    u, v = F.col("u"), F.col("v")
    links = materialise(links.where(u != v).select(u.cast("long").alias("u"), v.cast("long").alias("v")), "links")
    rows = 2 * links.count()
    while True:
        links = _small_star(links, rows)
        both = links.unionByName(links.select(v.alias("u"), u.alias("v")))
        # in a forest of stars no vertex goes up to two others, or up and down
        loose = (F.min("v") < u) & (F.max("v") != F.min("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"), loose.alias("loose"))
        least = materialise(_dealt(least, rows), "least")
        rows, loose = least.agg(F.coalesce(F.sum("degree"), F.lit(0)), F.count_if("loose")).first()
        if not loose:
            return least.select(u.alias("id"), F.least("u", "m").alias("component"))
        links = lookup(both, least, "u", "degree", rows).where(v > u).select(v.alias("u"), F.least("u", "m").alias("v")).where(u != v)


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components that ``labels`` (id, component) become with more links (u, v) between components. Only the components that the links join are looked at again."""
    over = components(links).select(F.col("id").alias("component"), F.col("component").alias("into"))
    roots = labels.where("id = component").select("component")  # one row of each, so none is hot
    new = over.join(roots.hint("merge"), "component", "left_anti").select(F.col("component").alias("id"), F.col("into").alias("component"))
    old = labels.join(over.hint("merge"), "component", "left").select("id", F.coalesce("into", "component").alias("component"))
    return materialise(old.unionByName(new), "labels")


def forest(close: np.ndarray, id_x: np.ndarray, id_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest: every vertex with the smallest id that it reaches within the block."""
    rows, columns = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    part, far = close[np.ix_(rows, columns)], np.iinfo(np.int64).max
    a, b = id_x[rows].copy(), id_y[columns].copy()
    while True:
        new_b = np.minimum(b, np.where(part, a[:, None], far).min(0))
        new_a = np.minimum(a, np.where(part, new_b[None, :], far).min(1))
        if (new_a == a).all() and (new_b == b).all():
            return np.concatenate([id_x[rows], id_y[columns]]), np.concatenate([a, b])
        a, b = new_a, new_b
