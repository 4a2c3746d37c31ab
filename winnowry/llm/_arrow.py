"""Vectorised reading of text columns: numpy over the bytes that Arrow holds, without a Python object per word."""
from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}
_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte; A-Z share theirs with a-z in the lower-casing table.
EXACT_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
LOWER_BYTES = EXACT_BYTES.copy()
LOWER_BYTES[65:91] = EXACT_BYTES[97:123]
BLOCK_BYTES = 1 << 20
#: What operators keep in a worker from task to task, such as a loaded vocabulary, until a task begins with ``tidy``.
remembered: dict[str, object] = {}


def tidy() -> None:
    """Workers stay from stage to stage: what other operators' tasks remembered in this one goes, and memory that they freed goes back to the system."""
    remembered.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def byte_class(members: str | bytes | list[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[b if isinstance(b, int) else ord(b) for b in members]] = True
    return table


#: [\x20\x09-\x0D]
SPACE = byte_class([0x20, 9, 10, 11, 12, 13])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i below n."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", _P), ("down", _P_INV)):
            x = np.full(size, base, U64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, and where each begins (n + 1 offsets). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]] if len(at) else whole[:0], at - at[0] if len(at) else np.zeros(1, np.int64)


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents of about ``size`` bytes: first row, last row + 1, bytes, offsets. A longer document makes a run of its own."""
    data, at = text_bytes(column)
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1)
        yield low, high, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def spans(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which ``inside[byte]`` holds, cut at the offsets ``at``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    member = np.frombuffer(data.tobytes().translate(inside.tobytes()), bool)  # faster than indexing, which widens the bytes
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = member[:-1]
    starts = np.flatnonzero(member & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = member[1:]
    ends = np.flatnonzero(member & (~after | edge[1:])) + 1
    return starts, ends


class Rolling:
    """Hashes of any span of a block of bytes, from the running sums of byte value times P^i."""

    def __init__(self, data: np.ndarray, table: np.ndarray = EXACT_BYTES):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(table[data] * up[:-1], out=self.sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends))


_TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Keeps the first 0 to 8 bytes of a little-endian number.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of at least one byte, A-Z as a-z, from their length and eight bytes at a time: work grows with the words, where ``Rolling`` prepares every byte."""
    padded = data.tobytes().translate(_TO_LOWER) + bytes(8)
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes that begin at each place
    size = ends - starts
    out = mix((eight[starts] & _FIRST_BYTES[np.minimum(size, 8)]) + size.astype(U64) * U64(_P))
    long = np.flatnonzero(size > 8)
    if len(long):
        many = (size[long] - 1) >> 3
        first = np.cumsum(many) - many
        at = (np.arange(first[-1] + many[-1]) - np.repeat(first, many) + 1) << 3
        row = np.repeat(long, many)
        part = eight[starts[row] + at] & _FIRST_BYTES[np.minimum(size[row] - at, 8)]
        out[long] = mix(out[long] + np.add.reduceat(mix(part + at.astype(U64) * U64(_P_INV)), first))
    return out


def words_per_row(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where each document's words begin among ``starts`` (n + 1 offsets)."""
    return np.searchsorted(starts, at, "left")


def binary_array(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the little-endian bytes of flat[at[i]:at[i + 1]]."""
    flat = np.ascontiguousarray(flat)
    width = flat.dtype.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
