"""Files of entries, read in byte ranges by many tasks, in batches and as a stream.

A format says which line opens an entry, or which one closes it.  A range reads the
entries that begin in it: it resynchronises at the first border at or after its
start, and reads its last entry to the end, wherever that lies.  So the ranges
of a file, however cut, give the entries of the whole file, each once.  Small files share
a range.

A format is registered by name: `register(spark, Bibtex)`, then
`spark.read.format("bibtex").load(path)`.  A new one is a subclass of Entries
with a name and one of `opens` and `closes`; `records` reads entries by it.

As a stream, a folder's files are read up to their size when a batch began, and from
there on when they have grown: an entry belongs to the batch in which it begins, and
is read as far as the file went.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from scriptorium.folder import address, file_system

#: Bytes of a range, and of the entries that a task holds.
SPLIT_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
_BACK = 1 << 16


class Format:
    """Borders of entries: a line that opens one, or a line that closes one."""

    def __init__(self, opens: bytes | None = None, closes: bytes | None = None):
        if (opens is None) == (closes is None):
            raise ValueError("a format has lines that open entries, or lines that close them")
        self.opens, self.closes = (re.compile(x) if x is not None else None for x in (opens, closes))

    def entries(self, stream: io.BufferedIOBase, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        """(place, bytes) of the entries that begin at start or later, before end; what stands before the first is one at 0."""
        at = self._line_before(stream, start)
        own: list[bytes] | None = [] if not start else None
        place = 0
        stream.seek(at)
        if start and self.opens:  # the line that holds the byte before
            at += len(stream.readline())
        for line in stream:
            if self.opens and self.opens.match(line):
                if own:
                    yield place, b"".join(own)
                if at >= end:
                    return
                own, place = [], at
            if own is not None:
                own.append(line)
            at += len(line)
            if self.closes and self.closes.match(line):
                if own:
                    yield place, b"".join(own)
                if at >= end:
                    return
                own, place = ([], at) if at >= start else (None, at)
        if own:
            yield place, b"".join(own)

    @staticmethod
    def _line_before(stream: io.BufferedIOBase, start: int) -> int:
        """Where the line begins that holds the byte before start."""
        high = start - 1
        while high > 0:
            low = max(0, high - _BACK)
            stream.seek(low)
            found = stream.read(high - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            high = low
        return 0


class Range(InputPartition):
    """Byte ranges of files: (address, start, end)."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        self.pieces = pieces


def _listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """Address and size of the files at a path, hidden ones left out."""
    fs, root = file_system(path)
    info = fs.get_file_info(root)
    head = path[: len(path) - len(root)] if path.endswith(root) else path.split("://")[0] + "://"
    found = fs.get_file_info(_selector(root)) if info.type.name == "Directory" else [info]
    ours = [f for f in found if f.is_file and f.path.lower().endswith(suffix) and not f.base_name.startswith(("_", "."))]
    return sorted((head + f.path, f.size) for f in ours)


def _selector(root: str):
    import pyarrow.fs

    return pyarrow.fs.FileSelector(root, recursive=True)


def _ranges(files: list[tuple[str, int, int]], most: int) -> list[Range]:
    """Ranges of some `most` bytes of (address, start, end); small files share one."""
    out: list[Range] = []
    held: list[tuple[str, int, int]] = []
    room = most
    for name, start, end in files:
        while start < end:
            step = min(room, end - start)
            if end - start <= most and step < end - start:  # a small piece is not cut
                out.append(Range(held))
                held, room = [], most
                continue
            held.append((name, start, start + step))
            start, room = start + step, room - step
            if not room:
                out.append(Range(held))
                held, room = [], most
    return [*out, Range(held)] if held or not out else out  # without any Spark would ask for one of its own


class _Reading:
    """What batch and stream readers share."""

    def __init__(self, source: Entries):
        self.path, self.most, self.suffix = source.path, source.most, source.suffix
        self.borders = source.borders()

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, str]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            columns = zip(*held, strict=True) if held else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["file", "entry", "raw"])

        for name, start, end in partition.pieces:
            fs, path = file_system(name)
            with fs.open_input_file(path) as source:
                for place, data in self.borders.entries(io.BufferedReader(source, 1 << 20), start, end):
                    lines = [line for line in re.split("\r?\n", data.decode("utf-8", "replace")) if line.strip(" ")]
                    if lines:
                        held.append((name, place, "\n".join(lines)))
                        size += len(data)
                    if size >= BATCH_BYTES:
                        yield batch()
                        held, size = [], 0
        yield batch()


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[Range]:
        return _ranges([(name, 0, size) for name, size in _listed(self.path, self.suffix)], self.most)


class _Stream(_Reading, DataSourceStreamReader):
    """Offsets are the sizes up to which files are read."""

    def initialOffset(self) -> dict[str, int]:
        return {}

    def latestOffset(self) -> dict[str, int]:
        return dict(_listed(self.path, self.suffix))

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        return _ranges([(name, start.get(name, 0), size) for name, size in sorted(end.items()) if size > start.get(name, 0)], self.most)


class Entries(DataSource):
    """Options: path, splitBytes (bytes of a range) and suffix (of the files that are read)."""

    opens: bytes | None = None
    closes: bytes | None = None
    ends = ""

    def __init__(self, options: Any):
        super().__init__(options)
        self.path, self.most, self.suffix = options.get("path"), int(options.get("splitBytes", SPLIT_BYTES)), options.get("suffix", self.ends).lower()
        if not self.path or self.most < 1:
            raise ValueError("path, and splitBytes of one or more")
        if "://" not in self.path:
            self.path = f"file://{self.path}"

    @classmethod
    def borders(cls) -> Format:
        return Format(cls.opens, cls.closes)

    def schema(self) -> str:
        return "file string, entry long, raw string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self)


class Bibtex(Entries):
    """An entry is opened by a line whose first sign is '@'."""

    opens = rb" *@"
    ends = ".bib"

    @classmethod
    def name(cls) -> str:
        return "bibtex"


class Ris(Entries):
    """An entry is closed by a line that begins with 'ER'."""

    closes = rb"ER"
    ends = ".ris"

    @classmethod
    def name(cls) -> str:
        return "ris"


def register(spark: SparkSession, *formats: type[Entries]) -> None:
    """Makes formats known by their names; Bibtex and Ris, if none are given."""
    for one in formats or (Bibtex, Ris):
        spark.dataSource.register(one)


def load(spark: SparkSession, form: type[Entries], path: str, **options: Any):
    """Entries (file, entry: its place in bytes, raw) of the files at path."""
    register(spark, form)
    return spark.read.format(form.name()).options(**options).load(address(spark, path))


def stream(spark: SparkSession, form: type[Entries], path: str, **options: Any):
    """The same as a stream of what is new in a folder."""
    register(spark, form)
    return spark.readStream.format(form.name()).options(**options).load(address(spark, path))
