"""Merkle fixity audit of web archive replicas.

A replica is a set of archive files of ``FANOUT ** LEVELS`` slots; a record's slot comes from its id, its offset from the
lengths of the records before it in the file. Leaves are SHA-256 digests of records as written; a node's digest covers
its ordered children and the range of offsets that they span. Replicas are compared root by root; only children of
differing nodes are read at the next level, down to the records: ``corrupt`` (other bytes), ``moved`` (same bytes at
another offset), ``missing`` or ``extra``. Records are hashed in the scan; only digests and lengths are shuffled.

Defined results: null url or body is empty; a null id is -1; rows that repeat an id share a slot, whose digest covers
theirs in order; extra columns are ignored; an empty replica makes the other's records missing or extra.
"""
from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import materialise

FANOUT, LEVELS = 8, 3
SLOTS = FANOUT**LEVELS


def record_text(url, body) -> F.Column:
    """A WARC resource record around a page."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(record, file, slot, n_records, offset, length, digest): one row per slot."""
    text = record_text(F.col(url_col), F.col(body_col))
    hashed = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1).cast("long")).alias("record"), F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("d"))
    copies = hashed.groupBy("record", "d", "size").agg(F.count(F.lit(1)).alias("k"))
    slots = copies.groupBy("record").agg(F.sum("k").alias("n_records"), F.sum(F.col("k") * F.col("size")).alias("length"), F.sort_array(F.collect_list(F.struct("d", "k"))).alias("each"))
    several = F.sha2(F.concat_ws(",", F.flatten(F.transform("each", lambda x: F.array_repeat(x.d, x.k.cast("int"))))), 256)
    slots = slots.select("record", F.expr(f"(record - pmod(record, {SLOTS})) div {SLOTS}").alias("file"), F.pmod("record", F.lit(SLOTS)).alias("slot"), "n_records", "length", F.when(F.col("n_records") == 1, F.col("each")[0]["d"]).otherwise(several).alias("digest"))
    before = Window.partitionBy("file").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return slots.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))


def tree(leaves: DataFrame) -> DataFrame:
    """(file, level, node, low, high, digest): leaves at level 0, the file's root at level LEVELS. A node has at most FANOUT children."""
    level = leaves.select("file", F.lit(0).alias("level"), F.col("slot").alias("node"), F.col("offset").alias("low"), (F.col("offset") + F.col("length")).alias("high"), "digest")
    every = level
    for k in range(1, LEVELS + 1):
        parts = level.groupBy("file", F.floor(F.col("node") / FANOUT).alias("parent")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("children"))
        digest = F.sha2(F.concat(F.col("low").cast("string"), F.lit("-"), F.col("high").cast("string"), F.lit(":"), F.array_join("children.digest", ",")), 256)
        level = parts.select("file", F.lit(k).alias("level"), F.col("parent").alias("node"), "low", "high", digest.alias("digest"))
        every = every.unionByName(level)
    return every


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """Trees of two replicas, written tables -> (file, slot, status) of the slots that differ."""
    branch = None
    for k in range(LEVELS, -1, -1):
        sides = []
        for side, name in ((one, "a"), (two, "b")):
            here = side.where(F.col("level") == k)
            if branch is not None:
                here = here.withColumn("parent", F.floor(F.col("node") / FANOUT)).join(branch, ["file", "parent"], "left_semi")
            sides.append(here.select("file", "node", F.col("digest").alias(f"digest_{name}"), F.col("low").alias(f"low_{name}")))
        met = sides[0].join(sides[1], ["file", "node"], "full_outer")
        differs = ~(F.col("digest_a").eqNullSafe(F.col("digest_b")) & F.col("low_a").eqNullSafe(F.col("low_b")))
        found = materialise(met.where(differs), f"differ_{k}")
        branch = found.select("file", F.col("node").alias("parent"))
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").when(F.col("digest_a") == F.col("digest_b"), "moved").otherwise("corrupt")
    return found.select("file", F.col("node").alias("slot"), status.alias("status"))


def fixity(one: DataFrame, two: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Audit of replica ``two`` against replica ``one``, both tables of pages: id, file, slot, n_records, offset, length, record_sha256, status, file_root (of replica one).
    A record that only the second replica holds has the second's offset, length and digest."""
    leaves = [materialise(records(x, id_col, url_col, body_col), "records") for x in (one, two)]
    trees = [materialise(tree(x), "tree", "level") for x in leaves]  # a level is a folder, so a descent reads its level only
    differ = audit(*trees)
    extra = leaves[1].join(differ.where("status = 'extra'").select("file", "slot"), ["file", "slot"], "left_semi")
    every = leaves[0].unionByName(extra, allowMissingColumns=False)
    roots = trees[0].where(F.col("level") == LEVELS).select("file", F.col("digest").alias("file_root"))
    out = every.join(differ, ["file", "slot"], "left").join(roots, "file", "left")
    return out.select(F.col("record").alias(id_col), "file", "slot", "n_records", "offset", "length", F.col("digest").alias("record_sha256"), F.coalesce("status", F.lit("ok")).alias("status"), "file_root")


def parse(raw: bytes) -> Iterator[tuple[int, int, str, bytes]]:
    """(offset, length, target, body) of each record of a WARC file. Offsets of a file of gzip members are those of its uncompressed bytes."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    at = 0
    while at < len(raw):
        head_end = raw.index(b"\r\n\r\n", at) + 4
        fields = dict(line.split(b": ", 1) for line in raw[at:head_end].split(b"\r\n")[1:] if b": " in line)
        size = int(fields[b"Content-Length"])
        end = head_end + size + 4
        yield at, end - at, fields.get(b"WARC-Target-URI", b"").decode(), raw[head_end : head_end + size]
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, compressed by gzip or not: path, offset, length, url, body. A file (1 GB by custom, 2 GB at most) is read whole by one task."""

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                rows = list(parse(bytes(raw)))
                yield pd.DataFrame({"path": name, "offset": [r[0] for r in rows], "length": [r[1] for r in rows], "url": [r[2] for r in rows], "body": [r[3] for r in rows]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(go, "path string, offset long, length long, url string, body binary")
