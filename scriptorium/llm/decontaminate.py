"""Benchmark decontamination by winnowed fingerprints.

A window is WINDOW consecutive words of a benchmark item; an item of fewer words
is one window.  Items and documents keep, of every WINDOW - GRAM + 1 neighbouring
word GRAM-grams, the one with the least hash.  Equal windows keep equal grams at
equal places, so a shared window always shares a fingerprint; each shared
fingerprint is then extended to the windows around it.  Items' distinct windows are
named once, each with one place of it and its set of items, so a document's window
is compared with one of equal hash, in all bytes, however many items share it.
Items shorter than a window are looked up by the hash of all their words at every
place.

The benchmark lies in the shared folder in blocks of some BLOCK_WORDS words.  A
worker holds one at a time, runs it against a chunk of documents, then the next,
and unites what they hit: documents are read once, and nothing is shuffled.

Null texts have no words.  Null item ids are not reported; rows that repeat an
item_id are one item in the result, with the windows of all its rows.  Every row
of docs gets its own result, repeated and null ids included.  Any length is read
whole.  Without items nothing is hit; an empty table gives an empty result.  Other
columns are read with carry only, in a struct, so their names clash with nothing.
"""

from __future__ import annotations

import pickle
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.arrays import ALNUM, CHUNK_BYTES, Words, chunks, column_bytes, gather, run_hashes, winnow
from scriptorium.llm.shared import Workspace, file_system

WINDOW = 10
GRAM = 5
BLOCK_WORDS = 2_000_000
#: Bytes of documents to a chunk where several blocks take turns.
MANY_BLOCKS_CHUNK = 64 << 20
#: Windows whose bytes are compared together, and sets of items that a block remembers.
WINDOWS_AT_ONCE, KNOWN_SETS = 1 << 16, 4096
_BITS = 20


def window_bytes(words: Words, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words of each window of n, end to end, and the words' lengths, a row a window."""
    word = first[:, None] + np.arange(n)
    length = words.end[word] - words.start[word]
    return gather(words.data, words.start[word].ravel(), length.ravel()), length


def equal_windows(one: Words, a: np.ndarray, two: Words, b: np.ndarray, n: int) -> np.ndarray:
    """Which windows of n words, a of one and b of two, are equal in every byte."""
    good = np.zeros(len(a), bool)
    for k in range(0, len(a), WINDOWS_AT_ONCE):
        x, y = a[k : k + WINDOWS_AT_ONCE], b[k : k + WINDOWS_AT_ONCE]
        same = np.ones(len(x), bool)
        for j in range(n):
            same &= one.end[x + j] - one.start[x + j] == two.end[y + j] - two.start[y + j]
        rows = np.flatnonzero(same)
        if len(rows):
            left, length = window_bytes(one, x[rows], n)
            right, _ = window_bytes(two, y[rows], n)
            size = length.sum(1)
            good[k + rows] = np.logical_and.reduceat(left == right, np.cumsum(size) - size)
    return good


class Windows:
    """The distinct windows of n words of a block's items: each by its hash, one place of it, and its set of items."""

    def __init__(self, words: Words, first: np.ndarray, item: np.ndarray, n: int, sets: dict[tuple[int, ...], int]):
        hashes = run_hashes(words.hash, n)[first]
        order = np.lexsort((first, hashes))
        hashes, first, item = hashes[order], first[order], item[order]
        fresh = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, bool)
        lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(hashes) else np.zeros(0, np.int64)
        rest = np.flatnonzero(~fresh)
        fresh[rest[~equal_windows(words, first[rest], words, first[lead[rest]], n)]] = True  # a hash that two windows share
        start = np.flatnonzero(fresh)
        self.n, self.hash, self.place = n, hashes[start], first[start]
        own = [tuple(np.unique(x).tolist()) for x in np.split(item, start[1:])] if len(start) else []
        self.items = np.array([sets.setdefault(x, len(sets)) for x in own], np.int64)

    def among(self, own: Words, words: Words, first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, set of items) of the windows at `first` that are ours, in every byte."""
        low, high = np.searchsorted(self.hash, hashes, "left"), np.searchsorted(self.hash, hashes, "right")
        many = high - low  # one at most, but for hashes that windows share
        place = np.repeat(first, many)
        window = np.repeat(high - np.cumsum(many), many) + np.arange(int(many.sum()))
        same = equal_windows(words, place, own, self.place[window], self.n)
        return place[same], self.items[window[same]]


class Benchmark:
    """Distinct windows of a block of items, found by fingerprint."""

    def __init__(self, ids: list[str | None], texts: list[str], window: int, gram: int):
        self.window, self.gram = window, gram
        data, offs = column_bytes(pa.array(texts, pa.string()))
        self.words = words = Words(data, offs, ALNUM, lower=True)
        self.ids = sorted({i for i in ids if i is not None})
        rank = {i: k for k, i in enumerate(self.ids)}
        item = np.array([rank.get(i, -1) for i in ids], np.int64)
        rows, owner, size = words.rows, words.row_of(), np.diff(words.rows)
        grams = run_hashes(words.hash, gram)
        at = np.flatnonzero(winnow(grams, window - gram + 1))
        inside = (owner[at] == owner[at + gram - 1]) & (size[owner[at]] >= window) if len(at) else at.astype(bool)
        self.prints = np.unique(grams[at[inside]])
        self.sieve = np.zeros(1 << _BITS, bool)
        self.sieve[(self.prints >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        sets: dict[tuple[int, ...], int] = {}
        first = np.arange(max(0, len(words) - window + 1))
        first = first[owner[first] == owner[first + window - 1]]
        self.whole = Windows(words, first, item[owner[first]], window, sets)
        self.short = []
        for n in range(1, window):
            items = np.flatnonzero(size == n)
            if len(items):
                self.short.append(Windows(words, rows[items], item[items], n, sets))
        self.sets = [[k for k in x if k >= 0] for x in sets]
        self.known: dict[tuple[int, ...], list[str]] = {}

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, length, set of items) of each occurrence of a window, of those that fingerprints lead to."""
        doc = words.row_of()
        found = [(np.zeros(0, np.int64),) * 3]
        grams = run_hashes(words.hash, self.gram)
        if len(grams) and len(self.prints):
            at = np.flatnonzero(winnow(grams, self.window - self.gram + 1))
            at = at[self.sieve[(grams[at] >> np.uint64(64 - _BITS)).astype(np.int64)]]
            slot = np.minimum(np.searchsorted(self.prints, grams[at]), len(self.prints) - 1)
            at = at[self.prints[slot] == grams[at]]
            first = np.unique((at[:, None] - np.arange(self.window - self.gram + 1)).ravel())  # windows that hold such a gram
            first = first[(first >= 0) & (first + self.window <= len(words))]
            first = first[doc[first] == doc[first + self.window - 1]]
            if len(first):
                place, items = self.whole.among(self.words, words, first, run_hashes(words.hash, self.window)[first])
                found.append((place, np.full(len(place), self.window), items))
        for short in self.short:
            hashes = run_hashes(words.hash, short.n)
            first = np.flatnonzero(np.isin(hashes, short.hash))
            first = first[doc[first] == doc[first + short.n - 1]]
            place, items = short.among(self.words, words, first, hashes[first])
            found.append((place, np.full(len(place), short.n), items))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def items_of(self, sets: tuple[int, ...]) -> list[str]:
        """The ids in some sets of items, in order; documents that hit the same windows share them."""
        if sets not in self.known:
            if len(self.known) >= KNOWN_SETS:
                self.known.clear()
            self.known[sets] = [self.ids[k] for k in sorted({k for x in sets for k in self.sets[x]})]
        return self.known[sets]


_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))


@lru_cache(1)
def _block(address: str) -> Benchmark:
    """A block of the benchmark; a worker holds one at a time."""
    fs, path = file_system(address)
    with fs.open_input_stream(path, compression=None) as source:
        return pickle.loads(source.read())


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, gram: int, block_words: int) -> list[str]:
    """Writes the benchmark as blocks of some block_words words to the shared folder; their addresses.

    A task makes a block and leaves it there.  Items are dealt by a hash, and a block has
    at most twice its share beside its longest item.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    count = max(1, int(-(-total // block_words)))
    folder = f"{Workspace(spark, 'benchmark').path}/blocks"
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)

    def put(table: pa.Table) -> pa.Table:
        fs, root = file_system(folder)
        name = f"{table.column('block')[0].as_py()}-{uuid.uuid4().hex}"  # a task that runs again leaves another
        with fs.open_output_stream(f"{root}/{name}", compression=None) as sink:
            sink.write(pickle.dumps(Benchmark(table.column("id").to_pylist(), table.column("text").to_pylist(), window, gram), 5))
        return pa.table([pa.array([name])], names=["name"])

    dealt = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(count)))
    names = [r["name"] for r in dealt.groupBy("block").applyInArrow(put, "name string").collect()]  # one a block
    return [f"{folder}/{name}" for name in sorted(names)]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, block_words: int = BLOCK_WORDS, carry: bool = False) -> DataFrame:
    """Per row of docs: id, n_words, n_hit, spans (first and last hit word of each run), items (sorted ids as strings); with carry, docs' columns in a struct `row`."""
    blocks = _blocks(benchmark, item_col, item_text_col, window, gram, block_words)
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry else [id_col])])
    given = docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([given.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches):
        for rows, data, offs in chunks(batches, "text", CHUNK_BYTES if len(blocks) == 1 else MANY_BLOCKS_CHUNK):
            words = Words(data, offs, ALNUM, lower=True)
            owner = words.row_of()
            found = [(np.zeros(0, np.int64),) * 2]
            items: list[list[str]] = [[] for _ in range(rows.num_rows)]
            for address in blocks:
                bench = _block(address)
                first, length, sets = bench.hits(words)
                found.append((first, length))
                hit = np.unique(np.stack([owner[first], sets], 1), axis=0)
                for own in np.split(hit, np.flatnonzero(np.diff(hit[:, 0])) + 1) if len(hit) else []:
                    d, more = int(own[0, 0]), bench.items_of(tuple(own[:, 1].tolist()))
                    items[d] = sorted({*items[d], *more}) if items[d] else more
            first, length = (np.concatenate(x) for x in zip(*found, strict=True))
            spans: list[list[dict]] = [[] for _ in range(rows.num_rows)]
            order = np.lexsort((length, first))
            for a, n in zip(first[order].tolist(), length[order].tolist(), strict=True):
                d = int(owner[a])
                a -= int(words.rows[d])
                if spans[d] and a <= spans[d][-1]["last"] + 1:
                    spans[d][-1]["last"] = max(spans[d][-1]["last"], a + n - 1)
                else:
                    spans[d].append({"first": a, "last": a + n - 1})
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(words.rows), pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))],
                names=schema.names,
            )

    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return given.mapInArrow(run, schema).select(F.col(f"row.`{id_col}`").alias(id_col), "n_words", hit.alias("n_hit"), "spans", "items", *(["row"] if carry else []))
