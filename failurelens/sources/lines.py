"""Text files as a Spark data source whose rows know their place: ``(file, offset, seq, value)``.

``spark.read.format("positioned_lines").load(path)`` (after ``register``) reads one file or all
files of a folder, in ranges of ``split`` bytes that any task can read by itself: a line belongs to the range
that holds its first byte. ``offset`` is that byte; ``seq`` is (number of the file by name) *
2**44 + offset, so ordering by ``seq`` is line order, without a count over the lines and
without reading them twice. Blank lines are skipped. With ``whole`` each file is one row.

Filters on ``file`` (=, IN) and on ``seq`` (=, <, <=, >, >=) choose files and ranges before anything is
read, if ``spark.sql.python.filterPushdown.enabled`` is on; the rest of a filter is Spark's.

As a stream, a micro-batch has what was added to the folder since the last: new files and
lines appended to known ones, up to the last complete line. Its offset lists the files with
the bytes that are done; files keep the number under which they were first seen.

Paths are local (or shared) ones, or URIs that pyarrow's file systems open. Files named with a leading
``_`` or ``.`` are skipped; compressed ones are refused, since they have no byte ranges. Bytes that
are not UTF-8 become U+FFFD.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual)

SCHEMA = "file string, offset bigint, seq bigint, value string"
#: Bits of ``seq`` for the offset.
OFFSET_BITS = 44
SPLIT = 64 << 20
#: Bytes read at a time, and lines in one batch at most.
BLOCK, ROWS = 4 << 20, 10_000
PACKED = (".gz", ".bz2", ".zst", ".xz", ".snappy", ".lz4", ".deflate")


@dataclass
class Range(InputPartition):
    """The lines of a file that begin in [start, end)."""

    file: str
    number: int
    start: int
    end: int


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[len("file:"):]
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def listed(path: str) -> list[tuple[str, int]]:
    """(file, size) below ``path``, by name; a missing path has none."""
    fs, root = opened(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        found = [info]
    else:
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
        found = [f for f in found if f.type == pafs.FileType.File
                 and not any(p.startswith(("_", ".")) for p in f.path[len(root):].strip("/").split("/"))]
    for f in found:
        if f.path.endswith(PACKED):
            raise ValueError(f"{f.path} is compressed: it cannot be read by byte ranges")
    return sorted((f.path, f.size) for f in found)


def lines_of(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, end); blank ones too."""
    at = start
    if start:
        # the line that a range cuts belongs to the range before
        stream.seek(start - 1)
        at, skip = start - 1, True
    else:
        stream.seek(0)
        skip = False
    held: list[bytes] = []
    while True:
        block = stream.read(BLOCK)
        if not block:
            if held and not skip and at < end:
                yield at, b"".join(held)
            return
        first = 0
        while (stop := block.find(b"\n", first)) >= 0:
            line = b"".join([*held, block[first:stop]])
            size, held, first = len(line) + 1, [], stop + 1
            if skip:
                skip = False
            elif at < end:
                yield at, line
            at += size
            if at >= end:
                return
        held.append(block[first:])


def batches(path: str, part: Range, whole: bool) -> Iterator[pa.RecordBatch]:
    fs, _ = opened(path)
    names = ["file", "offset", "seq", "value"]

    def batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        at = [r[0] for r in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array([part.file] * len(rows), pa.string()), pa.array(at, pa.int64()),
             pa.array([(part.number << OFFSET_BITS) + x for x in at], pa.int64()),
             pa.array([r[1].decode("utf-8", "replace") for r in rows], pa.string())], names)

    with fs.open_input_file(part.file) as stream:
        if whole:
            yield batch([(0, stream.read())])
            return
        rows, size = [], 0
        for at, line in lines_of(stream, part.start, part.end):
            line = line.removesuffix(b"\r")
            if line.strip():
                rows.append((at, line))
                size += len(line)
            if len(rows) >= ROWS or size >= BLOCK:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)


def ranges(file: str, number: int, start: int, end: int, split: int) -> list[Range]:
    return [Range(file, number, at, min(at + split, end)) for at in range(start, end, split)]


class LinesReader(DataSourceReader):
    def __init__(self, path: str, split: int, whole: bool):
        self.path, self.split, self.whole = path, split, whole
        self.files: set[str] | None = None
        self.low, self.high = 0, 1 << 62  # of seq, both included

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("file",) and isinstance(f, (EqualTo, In)):
                mine = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.files = mine if self.files is None else self.files & mine
            elif column == ("seq",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            yield f  # ranges are coarse: Spark filters their rows again

    def partitions(self) -> list[Range]:
        found = []
        for number, (file, size) in enumerate(listed(self.path)):
            if self.files is not None and file not in self.files:
                continue
            base = number << OFFSET_BITS
            if self.whole:
                found += [Range(file, number, 0, size)] if self.low <= base <= self.high else []
                continue
            found += [r for r in ranges(file, number, 0, size, self.split)
                      if base + r.start <= self.high and base + r.end > self.low]
        return found

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty input
            return iter(())
        return batches(self.path, partition, self.whole)


def complete(path: str, file: str, start: int, size: int) -> int:
    """The end of the last complete line of ``file`` between ``start`` and ``size``."""
    fs, _ = opened(path)
    with fs.open_input_file(file) as stream:
        end = size
        while end > start:
            low = max(start, end - (1 << 16))
            stream.seek(low)
            stop = stream.read(end - low).rfind(b"\n")
            if stop >= 0:
                return low + stop + 1
            end = low
    return start


class LinesStream(DataSourceStreamReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "[]"}

    def latestOffset(self) -> dict:
        found = dict(listed(self.path))
        for file, size in found.items():
            done = self.known.get(file, 0)
            self.known[file] = complete(self.path, file, done, size) if size > done else done
        return {"files": json.dumps(list(self.known.items()))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        done, now = (json.loads(o["files"]) for o in (start, end))
        if len(self.known) < len(now):
            self.known = dict(now)  # after a restart: the order in which files were first seen
        before = dict(done)
        return [r for number, (file, size) in enumerate(now)
                for r in ranges(file, number, before.get(file, 0), size, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return iter(())
        return batches(self.path, partition, False)

    def commit(self, end: dict) -> None:
        pass


class PositionedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "positioned_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options["path"], int(self.options.get("split", SPLIT)),
                           self.options.get("whole", "false").lower() == "true")

    def streamReader(self, schema) -> LinesStream:
        return LinesStream(self.options["path"], int(self.options.get("split", SPLIT)))


def register(spark: SparkSession) -> None:
    """Make the source known to the session, with filter pushdown."""
    from failurelens.session import ship_package
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PositionedLines)
