"""Questions from blocks of documents to shards of a corpus-wide index, and back.

Documents are dealt to blocks of some BLOCK_BYTES by a hash.  A block sends each
distinct key once to the key's shard, with what it counted, so a key that is
everywhere costs a shard one entry a block and never its occurrences.  The shard
answers every block in the order of its keys; the block, computed again from the
same rows, knows that order.  A shard for which a block has nothing gets no message.  Everything is one lazy plan, in which Spark reuses
the exchange of the documents.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
SHARD_BYTES = 32 << 20
MESSAGE = "block long, shard int, payload binary"
_NAMES = ["block", "shard", "payload"]


def pack(*arrays) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, 5), 1)


def unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(data))


def layout(docs: DataFrame, text_col: str, block_bytes: int | None = None, shard_bytes: int | None = None) -> tuple[int, int]:
    """Numbers of blocks and of shards for all bytes of text."""
    block_bytes, shard_bytes = block_bytes or BLOCK_BYTES, shard_bytes or SHARD_BYTES
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    return max(1, -(-total // block_bytes)), max(1, -(-total // shard_bytes))


def blocked(docs: DataFrame, id_col: str, text_col: str, blocks: int, **more) -> DataFrame:
    """block, id, text (null as '') and more columns; equal rows share a block."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.pmod(F.xxhash64(F.col(id_col), text), F.lit(blocks)).alias("block"), F.col(id_col).alias("id"), text.alias("text"), *[c.alias(n) for n, c in more.items()])


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of 64-bit keys, ascending with them."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def runs_of(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, begin, end) of the shards that ascending numbers name; none for a shard without any."""
    starts = np.flatnonzero(np.diff(shard, prepend=-1))
    return list(zip(shard[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(shard)], strict=False))


def small(x: np.ndarray) -> np.ndarray:
    """The same non-negative integers in as few bytes as they need."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    block, shard, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([pa.array(block, pa.int64()), pa.array(shard, pa.int32()), pa.array(payload, pa.binary())], names=_NAMES)


def number(key: tuple) -> int:
    """The value of a one-column group key."""
    value = key[0]
    return value.as_py() if hasattr(value, "as_py") else int(value)


def received(table: pa.Table) -> list[tuple[int, int, tuple]]:
    """Messages in the order of block and shard."""
    rows = zip(*(table.column(n).to_pylist() for n in _NAMES), strict=True)
    return sorted(((b, s, unpack(p)) for b, s, p in rows), key=lambda x: x[:2])


def ask_recurring(block: int, keys: np.ndarray, shards: int) -> list[tuple[int, int, bytes]]:
    """Messages that ask which keys of a block (one for each occurrence) occur twice anywhere."""
    known, counts = np.unique(keys, return_counts=True)
    return [(block, s, pack(known[a:b], np.packbits(counts[a:b] > 1))) for s, a, b in runs_of(shard_of(known, shards))]


def answer_recurring(key: tuple, table: pa.Table) -> pa.Table:
    """A shard's answers: a bit for each key, whether it occurs twice."""
    rows = received(table)
    keys = np.concatenate([x[2][0] for x in rows])
    twice = np.concatenate([np.unpackbits(x[2][1], count=len(x[2][0])) for x in rows])
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = np.bincount(back, weights=twice) + counts > 1
    out, at = [], 0
    for block, shard, (own, _) in rows:
        out.append((block, shard, pack(np.packbits(again[back[at : at + len(own)]]))))
        at += len(own)
    return messages(out)


def told_recurring(table: pa.Table, keys: np.ndarray, shards: int) -> np.ndarray:
    """The ascending distinct keys of a block of which the answers say that they recur."""
    known = np.unique(keys)
    yes = np.zeros(len(known), bool)
    for (_, a, b), (_, _, (bits,)) in zip(runs_of(shard_of(known, shards)), received(table), strict=True):
        yes[a:b] = np.unpackbits(bits, count=b - a).astype(bool)
    return known[yes]


def answer_owned(key: tuple, table: pa.Table) -> pa.Table:
    """Of each key that occurs twice anywhere, to the first block that asked: its place among the block's keys, and all blocks that asked."""
    rows = received(table)
    size = np.array([len(x[2][0]) for x in rows])
    keys = np.concatenate([x[2][0] for x in rows])
    twice = np.concatenate([np.unpackbits(x[2][1], count=len(x[2][0])) for x in rows])
    block = np.array([x[0] for x in rows])
    who = np.repeat(np.arange(len(rows)), size)
    place = np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)
    order = np.lexsort((who, keys))  # rows come by block
    start = np.flatnonzero(np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]])) if len(keys) else np.zeros(0, np.int64)
    many = np.diff(start, append=len(keys))
    again = (many > 1) | (np.add.reduceat(twice[order], start) > 0) if len(keys) else many > 1
    start, many = start[again], many[again]
    first = order[start]
    by = np.lexsort((place[first], who[first]))
    first, start, many = first[by], start[by], many[by]
    asked = block[who[order[np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())]]]
    ends, out = np.concatenate([[0], np.cumsum(many)]), []
    for owner, a, b in runs_of(who[first]):
        out.append((int(block[owner]), rows[owner][1], pack(small(np.diff(place[first[a:b]], prepend=0)), small(many[a:b]), small(asked[ends[a] : ends[b]]))))
    return messages(out)


def told_owned(table: pa.Table, keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's ascending distinct keys the places of those that it owns, how many blocks asked for each, and which."""
    base = {s: a for s, a, _ in runs_of(shard_of(keys, shards))}
    found = [(base[s] + np.cumsum(steps, dtype=np.int64), many.astype(np.int64), asked.astype(np.int64)) for _, s, (steps, many, asked) in received(table)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the ascending known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values
