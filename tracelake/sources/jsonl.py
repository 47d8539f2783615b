"""A source for files of lines that grow in place, batch or streaming: format("growing_lines").

Spark's file source reads a file once; this one keeps a byte offset for each file. Only whole lines are read, so a line
that is still being written waits; lines over `max_line` bytes are skipped and the offset passes them. Options: path, a
folder that driver and executors share; suffix (.jsonl); max_line (8 MiB); split (64 MiB), bytes in one partition.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, byte_offset bigint, text string"
MAX_LINE = 8 << 20


@dataclass
class Span(InputPartition):
    file: str
    start: int
    end: int


def listing(path: str, suffix: str) -> list[str]:
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(suffix))


def whole_lines(file: str, start: int) -> int:
    """The offset after the last line feed, found from the end of the file."""
    end = os.path.getsize(file)
    with open(file, "rb") as f:
        at = end
        while at > start:
            low = max(start, at - 65536)
            f.seek(low)
            if (i := f.read(at - low).rfind(b"\n")) >= 0:
                return low + i + 1
            at = low
    return start


def read_lines(file: str, start: int, end: int, max_line: int = MAX_LINE) -> Iterator[tuple[str, int, str]]:
    """(file, offset, text) of the whole lines that begin in [start, end)."""
    with open(file, "rb") as f:
        f.seek(start)
        while (at := f.tell()) < end:
            line = f.readline(max_line + 1)
            if not line.endswith(b"\n"):
                if len(line) <= max_line:
                    return
                while line and not line.endswith(b"\n"):
                    line = f.readline(max_line + 1)
                continue
            if text := line.rstrip(b"\r\n"):
                yield file, at, text.decode("utf-8", "replace")


def cut(file: str, start: int, end: int, split: int) -> list[Span]:
    """Spans that begin at line starts, of about `split` bytes."""
    out = []
    with open(file, "rb") as f:
        while start < end:
            f.seek(min(end, start + split))
            f.readline()
            stop = min(end, f.tell()) if start + split < end else end
            out.append(Span(file, start, stop))
            start = stop
    return out


class _Reads:
    def __init__(self, options):
        self.path, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.max_line, self.split = int(options.get("max_line", MAX_LINE)), int(options.get("split", 64 << 20))

    def read(self, part: Span) -> Iterator[tuple]:
        return read_lines(part.file, part.start, part.end, self.max_line)


class BatchReader(_Reads, DataSourceReader):
    def partitions(self):
        return [s for f in listing(self.path, self.suffix) for s in cut(f, 0, whole_lines(f, 0), self.split)]


class StreamReader(_Reads, DataSourceStreamReader):
    """Offsets are {file: byte}; they live in the query's checkpoint."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f: whole_lines(f, 0) for f in listing(self.path, self.suffix)}

    def partitions(self, start: dict, end: dict):
        return [s for f, to in sorted(end.items()) if to > start.get(f, 0) for s in cut(f, start.get(f, 0), to, self.split)]

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return BatchReader(self.options)

    def streamReader(self, schema):
        return StreamReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(GrowingLines)
