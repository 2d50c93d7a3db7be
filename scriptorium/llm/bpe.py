"""Byte-level BPE on contiguous rank arrays.

A text is cut into pre-tokens by whole-array rules on code points.  Each
distinct pre-token is encoded once: its parts and the merge ranks of adjacent
parts lie in rows of small matrices, one row a word; the smallest rank of every
row is found, its boundary deleted, and the ranks beside it refreshed, until no
row has a mergeable pair.  Pre-tokens past SHORT bytes use a heap over linked
parts, which gives the same parts without the quadratic scan.

Null texts are empty; an empty text has no ids and decodes to ''.  Any text
length is encoded whole.  Rows repeat as they come in, each with its own result;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.arrays import binary_rows, chunks, gather, hash_runs
from scriptorium.llm.cache import WordMemory

SHORT = 64
NONE = np.int32(2**31 - 1)
_WIDTHS = (4, 8, 12, 16, 24, 32, SHORT)
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    # Unicode's White_Space property; fixed values
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return table


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, and its byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pre_tokens(data: np.ndarray, offs: np.ndarray, special: bytes = b"") -> np.ndarray:
    """Byte starts of the pre-tokens of a chunk of UTF-8 texts; they cover it without gaps.

    Contractions, then runs of letters, numbers or other signs with at most one
    space before, then white space, whose last character stands alone before
    more text.  `special` is one token wherever it occurs.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(at)
    if not n:
        return at
    code = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[code]
    edge = np.zeros(n + 1, bool)  # a text, or what stands beside a special token, begins here
    edge[np.searchsorted(at, offs)] = edge[n] = True
    specials = []
    if special:
        whole, i = data.tobytes(), -1
        text_ends = set(offs.tolist())
        while (i := whole.find(special, i + 1)) >= 0:
            if not any(j in text_ends for j in range(i + 1, i + len(special))):
                specials.append((int(np.searchsorted(at, i)), int(np.searchsorted(at, i + len(special)))))
                i += len(special) - 1
        for a, b in specials:
            edge[[a, b]] = True
    fresh = edge[:n].copy()
    fresh[1:] |= kind[1:] != kind[:-1]
    after_space = np.zeros(n, bool)
    after_space[1:] = (code[:-1] == 32) & ~edge[1:n]
    blank = kind == _SPACE
    start = fresh & (blank | ~after_space)
    start[:-1] |= blank[:-1] & ~blank[1:] & ~edge[1:n]
    for i in np.flatnonzero(start[:-1] & (code[:-1] == 39) & (kind[1:] == _LETTER) & ~edge[1:n]):
        tail = "".join(map(chr, code[i + 1 : i + 3])) if i + 2 < n and not edge[i + 2] else chr(code[i + 1])
        size = 2 if tail[0] in "stmd" else 3 if tail in ("re", "ve", "ll") else 0
        if size:
            start[i + 1] = False
            if i + size < n:
                start[i + size] = True
    for a, b in specials:
        start[a] = True
        start[a + 1 : b] = False
    return at[start]


class ByteBpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab, alphabet = told["model"]["vocab"], byte_alphabet()
        self.special = {t["content"].encode(): t["id"] for t in told["added_tokens"]}
        if len(self.special) > 1:
            raise ValueError("one special token at most")
        texts = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.size = max(texts) + 1
        parts = [texts.get(i, b"") for i in range(self.size)]
        self.token_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.token_length = np.array([len(p) for p in parts], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.byte_id = np.zeros(256, np.int32)
        for sign, b in alphabet.items():
            self.byte_id[b] = vocab[sign]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.memory = WordMemory()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids; NONE where they never merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def _short(self, parts: np.ndarray, length: np.ndarray, put) -> None:
        """Merge words of a similar size; put(rows, parts, lengths) takes those that are done."""
        rows = np.arange(len(parts))
        rank = np.full((len(parts), parts.shape[1] - 1), NONE, np.int32)
        held = np.arange(parts.shape[1] - 1) < (length - 1)[:, None]
        rank[held] = self.ranks(parts[:, :-1][held], parts[:, 1:][held])
        while len(rows):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            least = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), NONE)
            done = least == NONE
            if done.any():
                put(rows[done], parts[done], length[done])
                go = ~done
                rows, parts, length, rank, at, least = rows[go], parts[go], length[go], rank[go], at[go], least[go]
                if not len(rows):
                    return
            line, cols = np.arange(len(rows)), np.arange(parts.shape[1] - 1)
            parts = np.where(cols <= at[:, None], parts[:, :-1], parts[:, 1:])
            parts[line, at] = self.merged[least]
            length = length - 1
            cols = cols[:-1]
            rank = np.where(cols < at[:, None], rank[:, :-1], rank[:, 1:])
            for i, ok in ((at - 1, at > 0), (at, at < length - 1)):
                r, c = line[ok], i[ok]
                rank[r, c] = self.ranks(parts[r, c], parts[r, c + 1])

    def _long(self, word: bytes) -> list[int]:
        """A heap over linked parts."""
        ids, n = self.byte_id[np.frombuffer(word, np.uint8)].tolist(), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if 0 <= i and (j := after[i]) < n:
                rank = self.rank_of.get(ids[i] * self.size + ids[j])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            if ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [x for x in ids if x >= 0]

    def encode_words(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, end to end, and their number for each word."""
        count = np.ones(len(start), np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        plain = np.ones(len(start), bool)
        for text, i in self.special.items():
            for row in np.flatnonzero(length == len(text)):
                if data[start[row] : start[row] + length[row]].tobytes() == text:
                    plain[row] = False
                    done.append((np.array([row]), np.array([[i]], np.int32), np.array([1])))
        low = 0
        for width in _WIDTHS:
            rows = np.flatnonzero((length > low) & (length <= width) & plain)
            low = width
            if len(rows):
                cols = np.arange(width)
                places = np.minimum(start[rows][:, None] + cols, len(data) - 1)
                parts = self.byte_id[data[places]]
                self._short(parts, length[rows], lambda r, p, n, rows=rows: done.append((rows[r], p, n)))
        for row in np.flatnonzero((length > SHORT) & plain):
            ids = np.array(self._long(data[start[row] : start[row] + length[row]].tobytes()), np.int32)
            done.append((np.array([row]), ids[None, :], np.array([len(ids)])))
        for rows, _, n in done:
            count[rows] = n
        ends = np.cumsum(count)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        for rows, parts, n in done:
            held = np.arange(parts.shape[1]) < n[:, None]
            flat[((ends - count)[rows][:, None] + np.arange(parts.shape[1]))[held]] = parts[held]
        return flat, count

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk, end to end, and the n + 1 places where texts begin."""
        start = pre_tokens(data, offs, next(iter(self.special), b""))
        length = np.diff(start, append=len(data))
        flat, count = self.memory.expand(hash_runs(data, start), lambda x: self.encode_words(data, start[x], length[x]))
        ends = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        return flat, ends[np.searchsorted(start, offs)]

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids of all texts, end to end, and where texts begin."""
        length = self.token_length[ids]
        ends = np.concatenate([[0], np.cumsum(length)])
        return gather(self.token_bytes, self.token_start[ids], length), ends[rows]


@lru_cache(4)
def byte_bpe(path: str) -> ByteBpe:
    """The encoder of a file, kept by the worker with its memory of words."""
    return ByteBpe(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """id, ids (little-endian unsigned 32-bit, binary) and, if wanted, the text decoded from them."""

    def run(batches):
        bpe = byte_bpe(path)
        for rows, data, offs in chunks(batches, "text"):
            ids, at = bpe.encode(data, offs)
            out = [rows.column(0), binary_rows(ids.astype("<u4").view(np.uint8), at * 4)]
            if decoded:
                back, ends = bpe.decode(ids, at)
                try:
                    back.tobytes().decode()
                    out.append(binary_rows(back, ends, pa.string()))
                except UnicodeDecodeError:
                    whole = back.tobytes()
                    out.append(pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=names)

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = [id_col, "ids"] + ["decoded"] * decoded
    kinds = [docs.schema[id_col].dataType, T.BinaryType(), T.StringType()]
    return given.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=False)]))
