"""Recorded captures of live feeds as a data source of Spark's own, for batches and streams.

A capture is a folder of text files, one message a line, named in the order in which they were recorded; a file is one
connection. A stream's offset is (phase, file, byte), so a query that is stopped goes on where it was, without loss or
repeat, and only whole lines are taken from a file that still grows. `line` is the message's place: file number and byte in
one number, so it orders messages over files, batches and restarts, and `connection` tells where a feed was cut.

With `backfill` a capture has two phases: first the files of history (pages, as a rule fetched newest first), then the live
ones. What both phases hold is dropped by `streaming.bars.once`.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bits of a byte's place in its file; the rest of `line` is the file's number. Live files count from LIVE on.
BYTE_BITS, LIVE = 40, 1 << 20
SPLIT = 64 << 20
BATCH = 8192
SCHEMA = "line bigint, value string"


@dataclass
class Stretch(InputPartition):
    """Lines that begin in [start, stop) of a file."""

    path: str
    number: int
    start: int
    stop: int


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a folder's files by name; hidden ones and those that Spark marks are left out."""
    system, root = fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


def _opened(path: str, root: str) -> io.BufferedReader:
    return io.BufferedReader(fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))[0].open_input_file(path), 1 << 20)


def _numbered(options: dict[str, str]) -> list[tuple[int, str, int, str]]:
    """(number, path, bytes, root) of all files: those of history first."""
    past, out = options.get("backfill"), []
    if past:
        files = _listed(past)
        files = files[::-1] if options.get("newestFirst", "false").lower() == "true" else files
        out += [(i, p, n, past) for i, (p, n) in enumerate(files)]
    return out + [(LIVE + i, p, n, options["path"]) for i, (p, n) in enumerate(_listed(options["path"]))]


def _whole(path: str, root: str, size: int, step: int = 1 << 20) -> int:
    """The byte after a file's last line end."""
    with _opened(path, root) as f:
        while size:
            low = max(0, size - step)
            f.seek(low)
            at = f.read(size - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            size = low
    return 0


def _lines(part: Stretch, root: str) -> Iterator[pa.RecordBatch]:
    """A line belongs to the stretch that it begins in."""
    lines, values = [], []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lines, pa.int64()), pa.array(values, pa.string())], ["line", "value"])

    with _opened(part.path, root) as f:
        at = max(part.start - 1, 0)
        f.seek(at)
        if part.start:
            at += len(f.readline())
        while at < part.stop:
            raw = f.readline()
            if not raw:
                break
            lines.append(part.number << BYTE_BITS | at)
            values.append(raw.rstrip(b"\r\n").decode("utf-8", "replace"))
            at += len(raw)
            if len(lines) == BATCH:
                yield batch()
                lines, values = [], []
    if lines:
        yield batch()


def _cut(number: int, path: str, start: int, stop: int, split: int) -> list[Stretch]:
    return [Stretch(path, number, a, min(a + split, stop)) for a in range(start, stop, split)]


class Captures(DataSource):
    """`captures`: options path, backfill, newestFirst (of backfill), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Whole(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Growing(dict(self.options))


class _Read:
    def __init__(self, options: dict[str, str]) -> None:
        self.options = {next((k for k in ("path", "backfill", "newestFirst", "splitBytes") if k.lower() == o.lower()), o): v for o, v in options.items()}
        self.split = int(self.options.get("splitBytes", SPLIT))

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return _lines(partition, self.options["path" if partition.number >= LIVE else "backfill"])


class _Whole(_Read, DataSourceReader):
    def partitions(self) -> Sequence[Stretch]:
        return [s for number, path, size, _ in _numbered(self.options) for s in _cut(number, path, 0, size, self.split)]


class _Growing(_Read, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"number": -1, "path": "", "byte": 0}

    def latestOffset(self) -> dict:
        files = _numbered(self.options)
        if not files:
            return self.initialOffset()
        number, path, size, root = files[-1]
        return {"number": number, "path": path, "byte": _whole(path, root, size)}

    def partitions(self, start: dict, end: dict) -> Sequence[Stretch]:
        """Files before the end's are taken whole: only the last one may grow. One that sorts before what was read stops the stream."""
        files = {number: (path, size) for number, path, size, _ in _numbered(self.options)}
        for o in (start, end):
            if o["number"] >= 0 and files.get(o["number"], ("",))[0] != o["path"]:
                raise ValueError(f"files of a capture are named in order, but {o['path']} is no longer number {o['number']}")
        out = []
        for number, (path, size) in files.items():
            if start["number"] <= number <= end["number"]:
                out += _cut(number, path, start["byte"] if number == start["number"] else 0, end["byte"] if number == end["number"] else size, self.split)
        return out

    def commit(self, end: dict) -> None:
        pass


def connection(line: Column) -> Column:
    """The number of a message's connection, from its `line`."""
    return F.shiftright(line, BYTE_BITS)


def recorded(spark: SparkSession, path: str, stream: bool = False, backfill: str | None = None, newest_first: bool = False, split: int = SPLIT) -> DataFrame:
    """(line, value) of a capture, as a batch or a stream."""
    spark.dataSource.register(Captures)
    read = (spark.readStream if stream else spark.read).format("captures").option("path", path).option("splitBytes", split)
    if backfill:
        read = read.option("backfill", backfill).option("newestFirst", str(newest_first).lower())
    return read.load()
