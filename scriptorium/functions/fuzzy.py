"""Approximate substring search.

`near_matches` finds the places where a needle occurs in a text with at most k
insertions, deletions and substitutions.  Cut into k + 1 pieces, a needle that
occurs with k errors has one piece unharmed, so `may_hold` lets rows without any
piece pass by without leaving the JVM.
"""

from __future__ import annotations

import pickle
import uuid
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from scriptorium import folder
from scriptorium.functions import bits

#: Characters of needles that are sent out together, and bytes of texts that are hashed together.
BLOCK_CHARS, CHUNK_BYTES = 1 << 20, 1 << 21
#: Bytes of texts to a chunk where several blocks take turns.
MANY_BLOCKS_BYTES = 64 << 20
#: Pairs of a needle and a text that may hold it that are searched together.
PAIRS = 4096
#: Windows whose distances are worked out in step.
WINDOWS = 4096
#: The most bytes of a piece that are looked up; a power of two.
GRAM = 32
_BITS = 20

MATCHES = T.ArrayType(T.StructType([*[T.StructField(n, T.IntegerType()) for n in ("start", "end", "dist")], T.StructField("matched", T.StringType())]))


def search(needle: str, text: str, k: int) -> list[tuple[int, int, int]]:
    """(start, end, distance) of the best hit of each group of overlapping hits, from the left."""
    n = len(needle)
    if not n:
        return []
    column = [(i, 0) for i in range(n + 1)]  # distance, start of the best alignment that ends here
    hits: list[tuple[int, int, int]] = []
    for j, c in enumerate(text, 1):
        left_up, column[0] = column[0], (0, j)
        for i in range(1, n + 1):
            old = column[i]
            column[i] = min((left_up[0] + (needle[i - 1] != c), left_up[1]), (old[0] + 1, old[1]), (column[i - 1][0] + 1, column[i - 1][1]))
            left_up = old
        d, start = column[n]
        if d <= k:
            hits.append((start, j, d))
    return _grouped(hits)


def _grouped(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The best of each group of overlapping hits, which come by their ends."""
    best: list[tuple[int, int, int]] = []
    reach = -1
    for hit in hits:
        if best and hit[0] < reach:
            if (hit[2], hit[0] - hit[1]) < (best[-1][2], best[-1][0] - best[-1][1]):
                best[-1] = hit
        else:
            best.append(hit)
        reach = max(reach, hit[1])
    return best


def may_hold(needle: Column, text: Column, k: int) -> Column:
    """False only where no hit is possible; a needle of at most k characters may be anywhere."""
    n = F.length(needle)
    cut = lambda i: F.floor(n * i / (k + 1)).cast("int")
    pieces = [F.contains(text, F.substring(needle, cut(i) + 1, cut(i + 1) - cut(i))) for i in range(k + 1)]
    return (n <= k) | reduce(lambda a, b: a | b, pieces)


def near_matches(needle: Column, text: Column, k: int) -> Column:
    """Array of hits (start, end, dist, matched); empty for a null or empty needle."""

    @F.pandas_udf(MATCHES)
    def found(needles: pd.Series, texts: pd.Series) -> pd.Series:
        pairs = [(s or "", t or "") for s, t in zip(needles.where(needles.notna(), None), texts.where(texts.notna(), None), strict=True)]
        # equal pairs, such as a title on many pages of one text, are sought once
        known = list(dict.fromkeys(pairs))
        hits = dict(zip(known, search_pairs(known, k), strict=True))
        return pd.Series([[{"start": a, "end": b, "dist": d, "matched": t[a:b]} for a, b, d in hits[s, t]] for s, t in pairs])

    # a row without any piece sends no text
    return found(needle, F.when(may_hold(needle, text, k), text))


def cuts(n: int, k: int) -> list[tuple[int, int]]:
    """(start, end) of the k + 1 pieces of n characters."""
    return [(n * i // (k + 1), n * (i + 1) // (k + 1)) for i in range(k + 1)]


def _windows(needle: str, text: str, k: int) -> list[tuple[int, int]]:
    """The surroundings of the needle's pieces, where alone hits can be."""
    n = len(needle)
    if n <= k:
        return [(0, len(text))]
    spans = []
    for a, b in cuts(n, k):
        at = text.find(needle[a:b])
        while at >= 0:
            spans.append((max(0, at - a - k), min(len(text), at - a + n + k)))
            at = text.find(needle[a:b], at + 1)
    joined: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if joined and low <= joined[-1][1]:
            joined[-1] = joined[-1][0], max(joined[-1][1], high)
        else:
            joined.append((low, high))
    return joined


def search_pairs(pairs: list[tuple[str, str]], k: int) -> list[list[tuple[int, int, int]]]:
    """What `search` finds for each (needle, text), from the surroundings of the needle's pieces only, all pairs at once."""
    windows = [(p, p, low, high) for p, (needle, text) in enumerate(pairs) if needle and text for low, high in _windows(needle, text, k)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in pairs]
    for step in range(0, len(windows), WINDOWS):
        part = windows[step : step + WINDOWS]
        first = part[0][0]
        own = pairs[first : part[-1][0] + 1]
        window, start, end, dist = bits.found([n for n, _ in own], [t for _, t in own], [(p - first, p - first, low, high) for p, _, low, high in part], k)
        order = np.lexsort((end, window))
        for w, *hit in zip(*(x[order].tolist() for x in (window, start, end, dist)), strict=True):
            out[part[w][0]].append(tuple(hit))
    return [_grouped(hits) for hits in out]


class Needles:
    """A block of needles, found by the hashes of the first bytes of their pieces."""

    def __init__(self, ids: list, needles: list[str], k: int):
        self.ids, self.needles, self.k = ids, needles, k
        self.anywhere = [x for x, needle in enumerate(needles) if 0 < len(needle) <= k]
        by: dict[int, dict[int, set[int]]] = {}
        for x, needle in enumerate(needles):
            for a, b in cuts(len(needle), k) if len(needle) > k else []:
                piece = needle[a:b].encode()
                size = min(GRAM, 1 << len(piece).bit_length() - 1)
                key = next(h for n, h in _hashes(np.frombuffer(piece[:size], np.uint8)) if n == size)
                by.setdefault(size, {}).setdefault(int(key[0]), set()).add(x)
        self.grams = {}
        for size, held in by.items():
            keys = np.array(sorted(held), np.uint64)
            seen = np.zeros(1 << _BITS, bool)
            seen[keys >> np.uint64(64 - _BITS)] = True
            self.grams[size] = keys, seen, [sorted(held[int(h)]) for h in keys]

    def pairs(self, data: np.ndarray, offs: np.ndarray) -> set[tuple[int, int]]:
        """(text, needle) of every text in which a piece may occur; offs are the texts' ends within data, from 0."""
        found = {(t, x) for x in self.anywhere for t in range(len(offs) - 1)}
        for size, hashes in _hashes(data):
            if size not in self.grams:
                continue
            keys, seen, held = self.grams[size]
            at = np.flatnonzero(seen[hashes >> np.uint64(64 - _BITS)])
            slot = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
            same = keys[slot] == hashes[at]
            texts = np.searchsorted(offs, at[same], "right") - 1
            for t, h in np.unique(np.column_stack([texts, slot[same]]), axis=0).tolist():
                found.update((t, x) for x in held[h])
        return found


def _hashes(data: np.ndarray):
    """(size, hashes of the `size` bytes from each place on) for sizes 1, 2, 4 to GRAM, as far as there are so many."""
    mix = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        hashes, size = (data.astype(np.uint64) + np.uint64(1)) * mix, 1
        while len(hashes):
            yield size, hashes
            if size == GRAM:
                return
            left, right = hashes[: max(0, len(hashes) - size)], hashes[size:]
            hashes = (left ^ left >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + right
            hashes, size = (hashes ^ hashes >> np.uint64(32)) * mix, 2 * size


def search_all(items: DataFrame, item_id: str, needle: str, docs: DataFrame, doc_id: str, text: str, k: int, block_chars: int | None = None) -> DataFrame:
    """(item_id, needle, doc_id, matches) of every pair of rows with a hit, `matches` as by `near_matches`.

    Needles lie in the shared folder in blocks of some block_chars characters, each written by
    the task that gathers it.  Texts are read once: a worker holds one block at a time and runs
    it against a chunk of texts, then the next.  Null or empty needles and texts have no hits;
    rows that repeat an id, or have none, count as rows of their own.
    """
    spark = items.sparkSession
    given = items.select(F.col(item_id).alias("id"), F.col(needle).alias("needle")).where(F.length("needle") > 0)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.length("text") > 0)
    total = given.agg(F.sum(F.length("needle"))).first()[0] or 0
    count = max(1, -(-total // (block_chars or BLOCK_CHARS)))
    schema = T.StructType([T.StructField(item_id, given.schema["id"].dataType), T.StructField(needle, T.StringType()), T.StructField(doc_id, texts.schema["id"].dataType), T.StructField("matches", MATCHES)])
    place = folder.new_folder(spark, "needles")

    def put(table: pa.Table) -> pa.Table:
        block = Needles(table.column("id").to_pylist(), table.column("needle").to_pylist(), k)
        fs, root = folder.file_system(place)
        name = f"{root}/{table.column('block')[0].as_py()}-{uuid.uuid4().hex}"  # a task that runs again leaves another
        with fs.open_output_stream(name, compression=None) as sink:
            sink.write(pickle.dumps(block, 5))
        return pa.table([pa.array([name.rsplit("/", 1)[1]])], names=["name"])

    dealt = given.withColumn("block", F.pmod(F.xxhash64("needle"), F.lit(count)))
    names = [r["name"] for r in dealt.groupBy("block").applyInArrow(put, "name string").collect()]
    return texts.mapInArrow(_scan([f"{place}/{n}" for n in sorted(names)], schema), schema)


@lru_cache(1)
def _block(address: str) -> Needles:
    """A block of needles; a worker holds one at a time."""
    fs, path = folder.file_system(address)
    with fs.open_input_stream(path, compression=None) as source:
        return pickle.loads(source.read())


def _scan(blocks: list[str], schema: T.StructType):
    types = [to_arrow_type(f.dataType) for f in schema.fields]
    most = CHUNK_BYTES if len(blocks) == 1 else MANY_BLOCKS_BYTES

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(1).cast(pa.large_string())
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2], np.uint8)
            near: dict[str, list[tuple[int, int]]] = {address: [] for address in blocks}
            first = 0
            while first < len(column):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
                for address in blocks:
                    near[address] += sorted((first + t, x) for t, x in _block(address).pairs(data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]))
                first = last
            for address, pairs in near.items():
                for k in range(0, len(pairs), PAIRS):  # searched all at a time
                    held, part = _block(address), pairs[k : k + PAIRS]
                    texts = {t: column[t].as_py() for t in {t for t, _ in part}}
                    out: list[tuple] = []
                    for (t, x), hits in zip(part, search_pairs([(held.needles[x], texts[t]) for t, x in part], held.k), strict=True):
                        if hits:
                            out.append((x, t, [{"start": a, "end": b, "dist": d, "matched": texts[t][a:b]} for a, b, d in hits]))
                    if out:
                        rows = [r for _, r, _ in out]
                        found = [pa.array([held.ids[x] for x, _, _ in out], types[0]), pa.array([held.needles[x] for x, _, _ in out], types[1]), batch.column(0).take(pa.array(rows)).cast(types[2]), pa.array([m for _, _, m in out], types[3])]
                        yield pa.RecordBatch.from_arrays(found, names=schema.names)

    return run
