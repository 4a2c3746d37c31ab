"""Blocks: runs of rows that one task reads together. What a corpus-wide table must tell about a block's words or pairs is asked
once per block and distinct item; rows keep the items' places in the block, packed."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ._arrow import blocks

BLOCK_BYTES = 16 << 20
_TYPES = (np.dtype("<u1"), np.dtype("<u2"), np.dtype("<u4"))


def pack_ints(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 in as few bytes as the largest needs, byte planes apart, deflated."""
    top = int(numbers.max()) if len(numbers) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T
    return bytes([width]) + zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack_ints(packed: bytes) -> np.ndarray:
    width = packed[0]
    planes = np.frombuffer(zlib.decompress(packed[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u4").ravel().astype(np.int64)


def numbered(batches: Iterator[pa.RecordBatch], text: int, size: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block number, rows) of runs of about ``size`` bytes of the text column with that index. Numbers are unique in a job; write what is
    made of them before it's used twice."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        for low, high, _, _ in blocks(batch.column(text), size):
            yield number, batch.slice(low, high - low)
            number += 1
            pa.default_memory_pool().release_unused()  # workers stay for the next stages


def runs(sizes: np.ndarray) -> np.ndarray:
    """Offsets (n + 1) of consecutive runs of these sizes."""
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def renumbered(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different codes (below n) in order, and the codes as places among them."""
    known = np.bincount(codes, minlength=n) > 0
    return np.flatnonzero(known), (np.cumsum(known) - 1)[codes]
