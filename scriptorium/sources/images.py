"""Images in files: grey ones of eight bits, as PNG or PGM, to tiles and back, and their regions.

A file is read where its row is, in bounded batches; tones go on as tiles (see
`operators.rasters`).  Of a region only its lines are decoded further than they must be:
a PNG's lines depend on those above them.  Files of other kinds, or that cannot be read, have
an error and no tiles.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PNG = b"\x89PNG\r\n\x1a\n"


def read_pgm(data: bytes) -> np.ndarray:
    """Tones of a binary PGM image of eight bits."""
    at, words = 2, []
    while len(words) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        words.append(int(data[at:end]))
        at = end
    width, height, most = words
    if most != 255:
        raise ValueError("not eight bits")
    return np.frombuffer(data, np.uint8, width * height, at + 1).reshape(height, width)


def read_png(data: bytes, last: int | None = None) -> np.ndarray:
    """Tones of a grey PNG image of eight bits that is not interlaced, down to line `last`."""
    at, packed, shape = len(_PNG), [], None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlaced) != (8, 0, 0):
                raise ValueError("not a plain grey image of eight bits")
            shape = height, width
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if shape is None:
        raise ValueError("no header")
    height, width = shape
    lines = height if last is None else max(0, min(height, last))
    raw = zlib.decompressobj().decompress(b"".join(packed), lines * (width + 1) or 1)
    if len(raw) < lines * (width + 1):
        raise ValueError("the image ends too soon")
    held = np.frombuffer(raw, np.uint8, lines * (width + 1)).reshape(lines, width + 1)
    out = np.zeros((lines + 1, width + 1), np.uint8)  # a line above and a column before, of nothing
    for y in range(lines):
        out[y + 1, 1:] = _line(int(held[y, 0]), held[y, 1:], out[y])
    return out[1:, 1:]


def _line(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A line's tones, from what its filter left of them."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, dtype=np.uint8)
    if kind == 2:
        return line + above[1:]
    if kind not in (3, 4):
        raise ValueError("no such filter")
    left, out, up = 0, [], above.tolist()
    for x, v in enumerate(line.tolist()):
        b, c = up[x + 1], up[x]
        if kind == 3:
            near = (left + b) // 2
        else:
            guess = left + b - c
            near = min(((abs(guess - left), 0, left), (abs(guess - b), 1, b), (abs(guess - c), 2, c)))[2]
        left = (v + near) & 255
        out.append(left)
    return np.array(out, np.uint8)


def write_png(tones: np.ndarray) -> bytes:
    """A grey PNG image."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.zeros((tones.shape[0], tones.shape[1] + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = 1, np.diff(tones, axis=1, prepend=0)
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", tones.shape[1], tones.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def read_image(data: bytes, last: int | None = None) -> np.ndarray:
    if data[:8] == _PNG:
        return read_png(data, last)
    if data[:2] == b"P5":
        return read_pgm(data)
    raise ValueError("neither PNG nor PGM")


def _each(images: DataFrame, content: str, fields: str, make: Callable[[bytes, dict], tuple]) -> DataFrame:
    """images without their content, with the fields that make(content, row) gives, and an error where it cannot."""
    kept = [c for c in images.columns if c != content]
    schema = T.StructType([*images.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, *T.StructType.fromDDL(fields + ", error string").fields])
    count = len(schema) - len(kept) - 1

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema).types
        for batch in batches:
            for k in range(0, batch.num_rows, 16):  # images are large
                part = batch.slice(k, 16)
                rest, out = part.drop_columns([content]), []
                for row, data in zip(rest.to_pylist(), part.column(content), strict=True):
                    try:
                        out.append((*make(data.as_py() or b"", row), None))
                    except (ValueError, IndexError, struct.error, zlib.error) as error:
                        out.append((*[None] * count, str(error)))
                yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds[len(kept) :], strict=True))], names=schema.names)

    return images.select(*[F.col(f"`{c}`") for c in kept], F.col(content)).mapInArrow(run, schema)


def tiles(images: DataFrame, content: str = "content") -> DataFrame:
    """Each image as one tile: top, left, height, width, data, known; its other columns are its keys."""

    def make(data: bytes, row: dict) -> tuple:
        tones = read_image(data)
        return 0, 0, *tones.shape, tones.tobytes(), None

    return _each(images, content, "top int, left int, height int, width int, data binary, known binary", make)


def regions(images: DataFrame, content: str = "content") -> DataFrame:
    """The region x, y, width, height of each image as a PNG image of its own, and its size.

    What a region takes in beyond the image is left out; one that takes in nothing is an error.
    """

    def make(data: bytes, row: dict) -> tuple:
        y, x = max(row["y"], 0), max(row["x"], 0)
        tones = read_image(data, row["y"] + row["height"])[y : row["y"] + row["height"], x : row["x"] + row["width"]]
        if not tones.size:
            raise ValueError("the region is empty")
        return write_png(tones), tones.shape[1], tones.shape[0]

    return _each(images, content, "region binary, region_width int, region_height int", make)
