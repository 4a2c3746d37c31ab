"""A data source of event lines in a folder of segments (at any depth), for batches and for streams that stop and go on.

A segment is a text file; segments are read in the order of their names, and only the last one still grows. So the place of a
stream is one name and one number of bytes, however many segments there are. Ranges of bytes are read by separate tasks; a line belongs to
the range in which it begins. A stream takes lines once they're ended; a batch also takes an open last line.

Paths are those that pyarrow's file systems open (local, file://, hdfs://, s3://), as Python workers read them.
"""
from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SPLIT_BYTES = 64 << 20
TAIL_BYTES = 1 << 20
BATCH_LINES = 10_000
SCHEMA = "segment string, offset long, value string"


@dataclass
class Range(InputPartition):
    """The lines of a segment that begin in [low, high)."""

    path: str
    low: int
    high: int


class Folder:
    def __init__(self, options: dict):
        self.where = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        if self.split < 1:
            raise ValueError("splitBytes must be positive")

    def _open(self):
        return pyarrow.fs.FileSystem.from_uri(self.where) if "://" in self.where else (pyarrow.fs.LocalFileSystem(), self.where)

    def segments(self) -> list[tuple[str, int]]:
        """(path, bytes) by name; hidden files and those that Spark hasn't committed aren't segments."""
        fs, top = self._open()
        found = fs.get_file_info(pyarrow.fs.FileSelector(top, allow_not_found=True, recursive=True))
        hidden = lambda path: any(x.startswith(("_", ".")) for x in path[len(top) :].split("/"))
        return sorted((f.path, f.size) for f in found if f.is_file and not hidden(f.path))

    def ended(self, path: str, size: int) -> int:
        """Bytes of a segment up to its last line end."""
        fs, _ = self._open()
        with fs.open_input_file(path) as f:
            high = size
            while high > 0:
                low = max(0, high - TAIL_BYTES)
                at = f.read_at(high - low, low).rfind(b"\n")
                if at >= 0:
                    return low + at + 1
                high = low
        return 0

    def ranges(self, path: str, low: int, high: int) -> list[Range]:
        return [Range(path, at, min(at + self.split, high)) for at in range(low, high, self.split)]

    def lines(self, part: Range) -> Iterator[tuple[int, bytes]]:
        fs, _ = self._open()
        with fs.open_input_file(part.path) as raw:
            at = max(part.low - 1, 0)
            raw.seek(at)
            f = io.BufferedReader(raw, TAIL_BYTES)
            if part.low:
                at += len(f.readline())  # ends with the line that begins before this range, or at its own first line
            while at < part.high and (line := f.readline()):
                yield at, line
                at += len(line)

    def batches(self, part: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, str]] = []
        for at, line in self.lines(part):
            rows.append((at, line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")))
            if len(rows) == BATCH_LINES:
                yield self._batch(part.path, rows)
                rows = []
        if rows:
            yield self._batch(part.path, rows)

    def _batch(self, path: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        at, text = zip(*rows, strict=True)
        name = path.rsplit("/", 1)[-1]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(at, pa.int64()), pa.array(text, pa.string())], ["segment", "offset", "value"])


class EventLinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = Folder(options)

    def partitions(self) -> list[Range]:
        return [r for path, size in self.folder.segments() for r in self.folder.ranges(path, 0, size)]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        return self.folder.batches(part) if part is not None else iter(())  # an empty folder has no ranges


class EventLinesStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = Folder(options)

    def initialOffset(self) -> dict:
        return {"segment": "", "at": 0}

    def latestOffset(self) -> dict:
        """The last segment's ended lines; all earlier segments are whole."""
        found = self.folder.segments()
        return {"segment": found[-1][0], "at": self.folder.ended(*found[-1])} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, size in self.folder.segments():
            if start["segment"] <= path <= end["segment"]:
                low = start["at"] if path == start["segment"] else 0
                out += self.folder.ranges(path, low, end["at"] if path == end["segment"] else size)
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return self.folder.batches(part)

    def commit(self, end: dict) -> None:
        """Nothing to release: segments are the writer's."""


class EventLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EventLinesReader:
        return EventLinesReader(dict(self.options))

    def streamReader(self, schema) -> EventLinesStream:
        return EventLinesStream(dict(self.options))


def read_event_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(segment, offset, value): all lines of the folder's segments, each with the byte at which it begins."""
    spark.dataSource.register(EventLines)
    return spark.read.format("event_lines").option("splitBytes", split_bytes).load(path)


def stream_event_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The same as a stream."""
    spark.dataSource.register(EventLines)
    return spark.readStream.format("event_lines").option("splitBytes", split_bytes).load(path)
