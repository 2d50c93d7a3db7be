"""A corpus-wide bigram language model in an Elias-Fano trie, and its scores.

Tokens are words, lower-cased A-Z, and an end for every text, which also stands
before the first word.  The probability of w after v is q + g * base(w), where q
is c(v, w) / (c(v) + PRIOR), g is PRIOR / (c(v) + PRIOR), and base(w) is
(c(w) + 1) / (N + V + 1): for every v these add up to one over the vocabulary and
one unknown word.

Counting and scoring are questions of blocks of documents to shards (see
blocks.py).  Shards of the first round count words and number them.  Shards of
the second hold the trie: contexts and, after monotone pointers into the next
level, their successors, each sequence in Elias-Fano form, with successors stored
as running sums by context, and a code of QUANT_BITS bits for every smoothed
probability q.  Levels are written to files of the shared folder, one set for each
attempt of a task, and memory-mapped; a question looks up its context, then searches the word's place among that context's successors.
A context of more than HEAVY tokens is spread over shards by successor.

Null texts are empty and score as their end alone.  Texts are scored whole, however
long.  Rows of one id, or without one, are scored each on its own; a null train
column means the row is not learnt from.  An empty table gives an empty result;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.arrays import NOT_BLANK, Words, column_bytes, mix
from scriptorium.llm.blocks import MESSAGE, blocked, layout, messages, number, pack, received, runs_of, shard_of, small
from scriptorium.llm.shared import Workspace, file_system

PRIOR = 100.0
QUANT_BITS = 8
HEAVY = 1 << 22
#: Bytes of text to a shard: its bigrams and their trie are held at once.
SHARD_BYTES = 8 << 20
#: The hash that stands for the end of a text.
END = np.uint64(0x1D8E4E27C47D124F)

_SELECT = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    for _r, _i in enumerate(i for i in range(8) if _b >> i & 1):
        _SELECT[_b, _r] = _i


class EliasFano:
    """An ascending sequence of integers: low bits packed, high bits in unary, with a rank directory."""

    FIELDS = ("shape", "low", "high", "ones")

    def __init__(self, shape: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.shape, self.low, self.high, self.ones = shape, low, high, ones
        self.n, self.bits = int(shape[0]), int(shape[1])

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, universe = len(values), int(values[-1]) + 1 if len(values) else 1
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 8 + 16, np.uint8)
        for a in range(0, n, 1 << 16) if bits else ():  # 2**16 values end on a byte
            part = values[a : a + (1 << 16)]
            grid = (part[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(bool)
            packed = np.packbits(grid.reshape(-1), bitorder="little")
            low[a * bits // 8 : a * bits // 8 + len(packed)] = packed
        raised = (values >> np.uint64(bits)).astype(np.int64)
        top = int(raised[-1]) if n else 0
        marks = np.zeros((n + top + 1) // 64 * 64 + 64, bool)
        marks[raised + np.arange(n)] = True
        high = np.packbits(marks, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return cls(np.array([n, bits], np.int64), low, high, ones)

    def _in_word(self, word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place of the rank-th set bit of 64-bit words."""
        place, rank = np.zeros(len(word), np.int64), rank.astype(np.int64)
        open_ = np.ones(len(word), bool)
        for k in range(8):
            byte = (word >> np.uint64(8 * k) & np.uint64(255)).astype(np.int64)
            count = np.bitwise_count(byte.astype(np.uint8)).astype(np.int64)
            here = open_ & (rank < count)
            place[here] = 8 * k + _SELECT[byte[here], rank[here]]
            open_ &= ~here
            rank = np.where(open_, rank - count, rank)
        return place

    def _select1(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        return word * 64 + self._in_word(self.high[word], i - self.ones[word])

    def _select0(self, i: np.ndarray) -> np.ndarray:
        zeros = np.arange(len(self.ones)) * 64 - self.ones
        word = np.minimum(np.searchsorted(zeros, i, "right") - 1, len(self.high) - 1)
        return word * 64 + self._in_word(~self.high[word], i - zeros[word])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        any_place = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
        word = any_place[at >> 3] >> (at & 7).astype(np.uint64)
        if self.bits > 56:
            over = self.low[(at >> 3) + 8].astype(np.uint64) << np.uint64(1) << (63 - (at & 7)).astype(np.uint64)
            word |= over
        return word & np.uint64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        return ((self._select1(i) - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def successor(self, x: np.ndarray, first: np.ndarray | int = 0, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First place in [first, end) with a value of at least x, by way of x's high bits; and whether it is x."""
        x = np.asarray(x, np.uint64)
        end = np.full(len(x), self.n) if end is None else end
        h = (x >> np.uint64(self.bits)).astype(np.int64)
        top = len(self.high) * 64 - self.n  # zeros
        inside = h < top
        h = np.minimum(h, max(top - 1, 0))
        lo = np.where(h > 0, self._select0(np.maximum(h - 1, 0)) - np.maximum(h - 1, 0), 0)
        hi = self._select0(h) - h
        lo, hi = np.where(inside, lo, self.n), np.where(inside, hi, self.n)
        lo, hi = np.clip(lo, first, end), np.clip(hi, first, end)
        close, want = hi.copy(), x & np.uint64((1 << self.bits) - 1)
        going = np.flatnonzero(lo < hi)
        while len(going):
            middle = (lo[going] + hi[going]) // 2
            less = self._low(middle) < want[going]
            lo[going[less]], hi[going[~less]] = middle[less] + 1, middle[~less]
            going = going[lo[going] < hi[going]]
        same = lo < close
        same[same] = self._low(lo[same]) == want[same]
        return lo, same

    def save(self, folder: str, name: str) -> None:
        for field in self.FIELDS:
            _save(f"{folder}/{name}.{field}", getattr(self, field))

    @classmethod
    def open(cls, folder: str, name: str) -> EliasFano:
        return cls(*(_open(f"{folder}/{name}.{field}") for field in cls.FIELDS))


def _save(address: str, values: np.ndarray) -> None:
    fs, path = file_system(address)
    with fs.open_output_stream(path, compression=None) as sink:
        np.lib.format.write_array(sink, np.ascontiguousarray(values))


def _open(address: str) -> np.ndarray:
    """The array, mapped where the shared folder is a file system of the machine, else read."""
    fs, path = file_system(address)
    if fs.type_name == "local":
        return np.load(path, mmap_mode="r")
    with fs.open_input_stream(path, compression=None) as source:
        return np.load(io.BytesIO(source.read()))


class BigramTrie:
    """Contexts, pointers, successors and quantised probabilities."""

    LEVELS = ("contexts", "pointers", "successors")

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray, book: np.ndarray):
        self.contexts, self.pointers, self.successors, self.codes, self.book = contexts, pointers, successors, codes, book

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, q: np.ndarray, bits: int = QUANT_BITS) -> BigramTrie:
        """From distinct bigrams, ascending by context and word, with their smoothed probabilities."""
        fresh = np.ones(len(context), bool)
        fresh[1:] = context[1:] != context[:-1]
        start = np.flatnonzero(fresh)
        ends = np.append(start[1:], len(context))
        # running sums: a context's words follow on the last word of the context before
        base = np.concatenate([[0], np.cumsum(word[ends - 1] + 1)])[:-1] if len(start) else start
        summed = word + np.repeat(base, ends - start)
        logs = np.log(q) if len(q) else np.zeros(0)
        low, high = (logs.min(), logs.max()) if len(q) else (0.0, 0.0)
        most = (1 << bits) - 2
        codes = 1 + np.rint((logs - low) / max(high - low, 1e-12) * most).astype(np.int64)
        total, times = np.bincount(codes, q, most + 2), np.bincount(codes, minlength=most + 2)
        book = total / np.maximum(times, 1)  # the mean of a code's probabilities keeps their sum; code 0 is none
        return cls(EliasFano.build(context[start]), EliasFano.build(np.append(start, len(context))), EliasFano.build(summed), codes.astype(np.uint8 if bits <= 8 else np.uint16), book)

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of the bigrams' probabilities, 0 for those not in the trie."""
        out = np.zeros(len(context), self.codes.dtype)
        if not self.contexts.n:
            return out
        place, known = self.contexts.successor(context)
        row = np.flatnonzero(known)
        place, word = place[row], word[row]
        first, end = (self.pointers.access(place + k).astype(np.int64) for k in (0, 1))
        before = np.zeros(len(row), np.uint64)
        before[first > 0] = self.successors.access(first[first > 0] - 1) + np.uint64(1)
        at, same = self.successors.successor(before + word.astype(np.uint64), first, end)
        out[row[same]] = self.codes[at[same]]
        return out

    def save(self, folder: str) -> None:
        """Writes the levels under an address of the shared folder."""
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        for name in self.LEVELS:
            getattr(self, name).save(folder, name)
        _save(f"{folder}/codes", self.codes)
        _save(f"{folder}/book", self.book)

    @classmethod
    def open(cls, folder: str) -> BigramTrie:
        """The levels, memory-mapped."""
        return cls(*(EliasFano.open(folder, n) for n in cls.LEVELS), _open(f"{folder}/codes"), _open(f"{folder}/book"))


class _Block:
    """A block's tokens: every text's words and its end."""

    def __init__(self, table: pa.Table):
        text = table.column("text").combine_chunks()
        words = Words(*column_bytes(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text), NOT_BLANK, lower=True)
        self.hash = np.insert(words.hash, words.rows[1:], END)
        self.rows = words.rows + np.arange(len(words.rows))
        train = np.array(table.column("train").to_pylist(), bool)
        self.train = np.repeat(train, np.diff(self.rows))
        self.keys, self.place = np.unique(self.hash, return_inverse=True)

    def ask_words(self, block: int, shards: int) -> list[tuple[int, int, bytes]]:
        counts = np.bincount(self.place, self.train, len(self.keys)).astype(np.int64)
        # every shard is asked, if for nothing but its totals
        cuts = np.searchsorted(shard_of(self.keys, shards), np.arange(shards + 1))
        return [(block, s, pack(self.keys[a:b], small(counts[a:b]))) for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]

    def told_words(self, table: pa.Table, shards: int) -> None:
        """Number and count of every distinct word, and the corpus's totals."""
        got = received(table)
        self.number = np.concatenate([x[2][0] for x in got]).astype(np.int64)
        self.count = np.concatenate([x[2][1] for x in got]).astype(np.int64)
        self.tokens, self.vocabulary = sum(x[2][2] for x in got), sum(x[2][3] for x in got)

    def bigrams(self) -> None:
        """Distinct (context, word) of the block by place, their training counts, and each token's."""
        before = np.empty_like(self.place)
        before[1:] = self.place[:-1]
        before[self.rows[:-1]] = np.searchsorted(self.keys, END)
        pair = before * len(self.keys) + self.place
        self.pairs, self.pair = np.unique(pair, return_inverse=True)
        self.context, self.word = np.divmod(self.pairs, len(self.keys))

    def routed(self, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Order of the bigrams by shard, context number and word number; (shard, begin, end) of those named."""
        c, w = self.number[self.context], self.number[self.word]
        at = mix(c.astype(np.uint64) + np.uint64(1))
        heavy = self.count[self.context] > HEAVY
        at[heavy] = mix(at[heavy] ^ w[heavy].astype(np.uint64))
        shard = ((at >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((w, c, shard))
        return order, runs_of(shard[order])

    def ask_bigrams(self, block: int, shards: int) -> list[tuple[int, int, bytes]]:
        self.bigrams()
        counts = np.bincount(self.pair, self.train, len(self.pairs)).astype(np.int64)
        order, named = self.routed(shards)
        out = []
        for s, a, b in named:
            row = order[a:b]
            fresh = np.ones(b - a, bool)
            fresh[1:] = self.context[row[1:]] != self.context[row[:-1]]
            first = np.flatnonzero(fresh)
            contexts = self.number[self.context[row[first]]]
            out.append((block, s, pack(small(np.diff(contexts, prepend=0)), small(np.diff(first, append=b - a)), small(self.count[self.context[row[first]]]), small(self.number[self.word[row]]), small(counts[row]))))
        return out

    def scores(self, table: pa.Table, shards: int, prior: float) -> tuple[np.ndarray, np.ndarray]:
        """Base and model scores of every text."""
        self.bigrams()
        order, named = self.routed(shards)
        q = np.zeros(len(self.pairs))
        for (_, a, b), (_, _, (codes, book)) in zip(named, received(table), strict=True):
            q[order[a:b]] = book[codes]
        base = (self.count + 1) / (self.tokens + self.vocabulary + 1)
        p = q + prior / (self.count[self.context] + prior) * base[self.word]
        return tuple(np.add.reduceat(np.log10(x)[i], self.rows[:-1]) for x, i in ((base, self.place), (p, self.pair)))


def _number_words(shards: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = received(table)
        shard = number(key)
        known, back = np.unique(np.concatenate([x[2][0] for x in rows]), return_inverse=True)
        count = np.bincount(back, np.concatenate([x[2][1] for x in rows]), len(known)).astype(np.int64) if len(known) else np.zeros(0, np.int64)
        out, at = [], 0
        for block, _, (keys, _) in rows:
            i = back[at : at + len(keys)]
            at += len(keys)
            out.append((block, shard, pack(small(i * shards + shard), small(count[i]), int(count.sum()), int((count > 0).sum()))))
        return messages(out)

    return run


def _answer_bigrams(prior: float, bits: int, folder: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = received(table)
        place = f"{folder}/{number(key)}-{uuid.uuid4().hex}"  # of this attempt alone
        asked, counts, totals = [], [], []
        for _, _, (steps, runs, total, words, count) in rows:
            contexts = np.cumsum(steps.astype(np.int64))
            asked.append(np.stack([np.repeat(contexts, runs.astype(np.int64)), words.astype(np.int64)]))
            counts.append(count.astype(np.int64))
            totals.append(np.repeat(total.astype(np.int64), runs.astype(np.int64)))
        context, word = np.concatenate(asked, axis=1)
        count, total = np.concatenate(counts), np.concatenate(totals)
        seen = count > 0
        order = np.lexsort((word[seen], context[seen]))
        c, w, n, t = (x[seen][order] for x in (context, word, count, total))
        fresh = np.ones(len(c), bool)
        fresh[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
        first = np.flatnonzero(fresh)
        q = (np.add.reduceat(n, first) if len(first) else n) / (t[first] + prior)
        BigramTrie.build(c[first], w[first], q, bits).save(place)
        del context, word, count, total, c, w, n, t, counts, totals
        trie = BigramTrie.open(place)
        return messages([(block, shard, pack(trie.find(contexts, words), np.array(trie.book))) for (block, shard, _), (contexts, words) in zip(rows, asked, strict=True)])

    return run


def score_corpus(docs: DataFrame, train_col: str, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR, bits: int = QUANT_BITS) -> DataFrame:
    """Learns from rows whose train_col is true, scores all: id, n_tokens, n_known, train_tokens, base_score, score."""
    folder = Workspace(docs.sparkSession, "tries").path
    blocks, shards = layout(docs, text_col, shard_bytes=SHARD_BYTES)
    given = blocked(docs, id_col, text_col, blocks, train=F.coalesce(F.col(train_col), F.lit(False)))
    out = T.StructType([docs.schema[id_col], *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")], *[T.StructField(n, T.DoubleType()) for n in ("base_score", "score")]])

    def ask_words(key, table):
        return messages(_Block(table).ask_words(number(key), shards))

    def ask_bigrams(key, table, told):
        if not table.num_rows:
            return messages([])
        block = _Block(table)
        block.told_words(told, shards)
        return messages(block.ask_bigrams(number(key), shards))

    def score(key, table, told):
        block = _Block(table)
        late = told.column("shard").to_numpy() >= shards
        rest = told.filter(pa.array(late))
        block.told_words(told.filter(pa.array(~late)), shards)
        base, model = block.scores(rest.set_column(1, "shard", pa.array(rest.column("shard").to_numpy() - shards, pa.int32())), shards, prior)
        known = np.add.reduceat((block.count > 0)[block.place].astype(np.int64), block.rows[:-1])
        n = len(base)
        return pa.table([table.column("id"), pa.array(np.diff(block.rows), pa.int64()), pa.array(known, pa.int64()), pa.array([block.tokens] * n, pa.int64()), pa.array(base, pa.float64()), pa.array(model, pa.float64())], names=out.names)

    words = given.groupBy("block").applyInArrow(ask_words, MESSAGE).groupBy("shard").applyInArrow(_number_words(shards), MESSAGE)
    bigrams = given.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(ask_bigrams, MESSAGE).groupBy("shard").applyInArrow(_answer_bigrams(prior, bits, folder), MESSAGE)
    told = words.unionByName(bigrams.withColumn("shard", F.col("shard") + F.lit(shards)))
    return given.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, out)
