"""Journals that grow, as a data source whose offsets are bytes of each file.

    spark.dataSource.register(JournalTail)
    spark.readStream.format("journal_tail").option("path", folder).option("types", "append_started,append_completed").load()

A batch reads the bytes that were added since the last one and no others; a long addition is cut into ranges for several tasks. Only whole
lines count: a line without its line feed waits. A file that became shorter is read from its beginning. Blank and broken lines and such that are no object are left
out, and with `types` those of another event. As a table (`spark.read`) the option `offset` says where each file is begun; a line
belongs to the place of its first byte. Paths are what pyarrow's file systems open; names that begin with `_` or `.` are not read.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a range that one task reads, and of one read.
RANGE_BYTES, READ_BYTES = 64 << 20, 1 << 20


@dataclass
class Range(InputPartition):
    """Lines that begin in start..stop of a file that counts up to end; `first`: a line begins at start."""

    file: str
    start: int
    stop: int
    end: int
    first: bool


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = path[5:]
    return fs.FileSystem.from_uri(path)


def whole_lines(path: str) -> dict[str, int]:
    """The files of a folder with the bytes up to their last line feed, looked for from the end."""
    from pyarrow import fs

    system, root = _open(path)
    out = {}
    for x in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        if x.type != fs.FileType.File or posixpath.basename(x.path)[0] in "_.":
            continue
        with system.open_input_file(x.path) as f:
            end = x.size
            while end > 0:
                begin = max(0, end - READ_BYTES)
                f.seek(begin)
                at = f.read(end - begin).rfind(b"\n")
                if at >= 0:
                    end = begin + at + 1
                    break
                end = begin
        out[x.path] = end
    return out


def ranges(start: dict[str, int], end: dict[str, int], size: int = RANGE_BYTES) -> list[Range]:
    """What was added between two offsets; a file that became shorter is read anew."""
    out = []
    for file, stop in sorted(end.items()):
        begin = start.get(file, 0)
        begin = 0 if stop < begin else begin
        out += [Range(file, a, min(a + size, stop), stop, a == begin) for a in range(begin, stop, size)]
    return out


def lines(f, r: Range) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the lines that begin in a range."""
    pos, skip = (r.start, False) if r.first else (r.start - 1, True)
    f.seek(pos)
    held = b""
    while pos < r.stop:
        data = f.read(min(READ_BYTES, r.end - pos - len(held)))
        if not data:
            return
        *done, held = (held + data).split(b"\n")
        for line in done:
            if pos >= r.stop:
                return
            if not skip:
                yield pos, line
            skip = False
            pos += len(line) + 1


def records(path: str, r: InputPartition, types: set[str]) -> Iterator[tuple]:
    if not isinstance(r, Range):  # what Spark asks for where there are no ranges
        return
    system, _ = _open(path)
    with system.open_input_file(r.file) as f:
        for at, line in lines(f, r):
            try:
                x = json.loads(line)
            except ValueError:
                continue
            if isinstance(x, dict):
                event = x.get("event")
                event = event if event is None or isinstance(event, str) else json.dumps(event)
                if not types or event in types:
                    yield r.file, at, event, line.decode()


class _Tail(DataSourceStreamReader):
    def __init__(self, path: str, types: set[str], size: int):
        self.path, self.types, self.size = path, types, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return whole_lines(self.path)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(start, end, self.size)

    def read(self, partition: Range) -> Iterator[tuple]:
        return records(self.path, partition, self.types)


class _Table(DataSourceReader):
    def __init__(self, path: str, types: set[str], size: int, offset: int):
        self.path, self.types, self.size, self.offset = path, types, size, offset

    def partitions(self) -> list[Range]:
        end = whole_lines(self.path)
        at = ranges({f: min(self.offset, n) for f, n in end.items()}, end, self.size)
        for r in at:
            r.first = r.start == 0  # an offset may be inside a line, which then is left out
        return at

    def read(self, partition: Range) -> Iterator[tuple]:
        return records(self.path, partition, self.types)


class JournalTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "journal_tail"

    def schema(self) -> str:
        return "file string, offset long, event string, line string"

    def _parts(self) -> tuple[str, set[str], int]:
        types = {t.strip() for t in self.options.get("types", "").split(",") if t.strip()}
        return self.options["path"], types, int(self.options.get("rangeBytes", RANGE_BYTES))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Tail(*self._parts())

    def reader(self, schema) -> DataSourceReader:
        return _Table(*self._parts(), int(self.options.get("offset", 0)))
