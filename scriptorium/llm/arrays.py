"""Whole-batch text primitives on numpy arrays.

Arrow hands a string column over as one byte buffer plus offsets.  Everything
here works on that buffer at once: word borders, 64-bit word hashes, hashes of
word runs and ragged gathers.  Chunks are bounded in bytes (a single longer
text is its own chunk), so memory follows the chunk and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
PIECE_BYTES = 1 << 18

_RNG = np.random.default_rng(20240229)
_BYTE_VALUE = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing A-Z.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base (or of its inverse) modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        step = np.full(max(n, 2 * PIECE_BYTES), _BASE if kind == "up" else _BASE_INVERSE, dtype=np.uint64)
        step[0] = 1
        have = np.cumprod(step, dtype=np.uint64)
        if n <= CHUNK_BYTES:
            _powers[kind] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its n + 1 offsets; null reads as empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, "" if kind == pa.large_string() else b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def spans(offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes; a longer row stands alone."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def tidy() -> None:
    """Gives freed memory back to the machine: Spark keeps workers between tasks, and they would keep their largest one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def chunks(batches, text: str = "text", most: int = CHUNK_BYTES):
    """(rows, bytes, offsets) of bounded size from record batches."""
    for batch in batches:
        data, offs = column_bytes(batch.column(batch.schema.get_field_index(text)))
        for lo, hi in spans(offs, most):
            yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        del batch, data, offs
    tidy()


class Words:
    """Words of a chunk: byte range, 64-bit hash, and first word of every row."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, member: np.ndarray, lower: bool):
        data = LOWER[data] if lower else data
        inside = member[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        first = offs[:-1][offs[:-1] < len(data)]
        before[first] = False
        self.data = data
        self.start = np.flatnonzero(inside & ~before)
        last = np.zeros(len(data), bool)
        last[:-1] = inside[1:] & before[1:]
        self.end = np.flatnonzero(inside & ~last) + 1
        self.rows = np.searchsorted(self.start, offs)
        self.hash = hash_runs(data, self.start, inside)

    def __len__(self) -> int:
        return len(self.start)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def hash_runs(data: np.ndarray, start: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the byte runs from each start to the next; bytes outside count for nothing."""
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):  # in pieces that stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(start, start[i] + PIECE_BYTES, "right")) - 1)
        if start[-1] - start[i] <= PIECE_BYTES:
            j = len(start)
        a, b = start[i], start[j] if j < len(start) else len(data)
        value = _BYTE_VALUE[data[a:b]]
        if inside is not None:
            value *= inside[a:b]
        value *= _power("up", b - a)[: b - a]
        own = start[i:j] - a
        out[i:j] = np.add.reduceat(value, own) * _power("down", int(own[-1]) + 1)[own]
        i = j
    return mix(out)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes, one for each start; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k > 8:  # differences of running sums
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * _power("up", len(words))[: len(words)], out=sums[1:])
        return mix((sums[k:] - sums[:n]) * _power("down", n)[:n])
    out = np.zeros(n, np.uint64)
    factor = 1
    for j in range(k):
        factor = factor * 0xD6E8FEB86659FD93 % 2**64
        out += words[j : j + n] * np.uint64(factor)
    return mix(out)


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each `width` neighbours; len - width + 1 values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def winnow(grams: np.ndarray, width: int, valid: np.ndarray | None = None) -> np.ndarray:
    """Which grams are a minimum of some `width` neighbouring ones; all if there are fewer.

    Every window keeps all its minima, so equal windows keep equal grams at equal places.
    valid: which windows count, by their first gram; then what is kept of a text does not depend on its neighbours.
    """
    if valid is None and (len(grams) < width or width <= 1):
        return np.ones(len(grams), bool)
    if len(grams) < width:
        return np.zeros(len(grams), bool)
    least = sliding(grams, width, np.minimum)
    if valid is not None:
        least = np.where(valid, least, np.uint64(0))
    ends = np.zeros(width - 1, np.uint64)
    return sliding(np.concatenate([ends, least, ends]), width, np.maximum) == grams


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs data[start : start + length], laid end to end."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return data[:0]
    return data[np.repeat(start - ends + length, length) + np.arange(total)]


def binary_rows(data: np.ndarray, offs: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A binary (or string) column over the bytes between offsets."""
    size = len(offs) - 1
    made = pa.Array.from_buffers(pa.large_binary(), size, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return made.cast(kind or pa.binary())
