"""One ordered text file written by many tasks.

Each task writes its texts, in order, to a part of its own beside the file, and tells its
place, name and length in its commit message; a task that runs again makes another part, and
only the one it commits counts.  The commit puts the parts one after the other, each where
the sum of the lengths before it says, in bounded pieces, into a file that then takes
the name: readers see the old file or the whole new one.  What parts are left over are
deleted, after a failure, too.

    frame.repartitionByRange("pos").sortWithinPartitions("pos").select("value")
         .write.format("one_text").mode("overwrite").save(address)
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from typing import Any

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from scriptorium.folder import address, file_system

PIECE_BYTES = 4 << 20


@dataclass
class Part(WriterCommitMessage):
    """A task's part: its place among the parts, its name, and its bytes."""

    place: int
    name: str
    size: int


class OneText(DataSource):
    """Options: path, the file's address.  The rows have one column of strings; null is nothing."""

    @classmethod
    def name(cls) -> str:
        return "one_text"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if len(schema.fields) != 1 or schema.fields[0].dataType.simpleString() != "string":
            raise ValueError("one column of strings")
        return _Writer(self.options, overwrite)


class _Writer(DataSourceWriter):
    def __init__(self, options: Any, overwrite: bool):
        self.path, self.overwrite = options.get("path"), overwrite
        if not self.path:
            raise ValueError("path, the address of a file")
        self.path = self.path if "://" in self.path else f"file://{self.path}"
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Part:
        place = TaskContext.get().partitionId()
        fs, root = file_system(self.parts)
        fs.create_dir(root, recursive=True)
        name, size, held, many = f"{place}-{uuid.uuid4().hex}", 0, [], 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as sink:
            for row in iterator:
                data = (row[0] or "").encode("utf-8", "surrogatepass")
                held.append(data)
                size, many = size + len(data), many + len(data)
                if many > PIECE_BYTES:
                    sink.write(b"".join(held))
                    held, many = [], 0
            sink.write(b"".join(held))
        return Part(place, name, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = file_system(self.parts)
        _, final = file_system(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.place)
        if not self.overwrite and fs.get_file_info(final).type != pyarrow.fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(self.path)
        whole = f"{root}/whole"
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(whole, compression=None) as sink:
            for part, start in zip(parts, accumulate((p.size for p in parts), initial=0), strict=False):
                if sink.tell() != start:
                    raise OSError(f"part {part.place} would lie at {sink.tell()}, not {start}")
                with fs.open_input_stream(f"{root}/{part.name}", compression=None) as source:
                    while piece := source.read(PIECE_BYTES):
                        sink.write(piece)
        size = fs.get_file_info(whole).size
        if size != sum(p.size for p in parts):
            raise OSError(f"{size} bytes instead of {sum(p.size for p in parts)}")
        if fs.get_file_info(final).is_file:
            fs.delete_file(final)
        fs.move(whole, final)
        fs.delete_dir(root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = file_system(self.parts)
        if fs.get_file_info(root).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(root)


def write_in_order(rows: DataFrame, pos: str, value: str, path: str, mode: str = "overwrite") -> str:
    """Writes a column's texts in the order of another; the file's address."""
    spark = rows.sparkSession
    spark.dataSource.register(OneText)
    place = address(spark, path)
    rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), pos).sortWithinPartitions(pos).select(value).write.format("one_text").mode(mode).save(place)
    return place
