"""Removal of passages that recur anywhere in the corpus.

A window of WINDOW words recurs if its word sequence starts anywhere else.  Of
every window the least GRAM-gram is an anchor; a recurring window has a recurring
anchor.  Blocks of documents ask shards which anchors recur, then about the windows
around those only.  A window that recurs in the corpus is confirmed once: the shard tells
the first block that asked, its owner, and which blocks asked.  Nobody else learns
that it recurs.  The owner takes one place of each window it owns, joins windows that touch
to passages, and sends each passage, as text, to the blocks that asked for its windows.

A block compiles the anchors of the passages it got into Aho-Corasick automata of at
most AUTOMATON_CHARS characters each, and streams all its documents through them.  Every
hit lays a passage along a document, word by word, and what is equal over a window's
length or more is removed.  Every occurrence of a window has its anchors at the same
places, so the automata find all of them; what a document shares with a passage over a
window's length is a window that recurs.  Each document is judged on the input, so
what is removed elsewhere does not matter.  That a window recurs is decided by 64-bit
hashes of its words, where it stands by the automata alone.

Null texts have no words.  Rows of the same id, or without one, are separate
documents; equal rows repeat each other.  Documents of fewer words than a window
keep all of them; longer ones are read whole.  An empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.arrays import NOT_BLANK, PIECE_BYTES, Words, binary_rows, column_bytes, gather, run_hashes, spans, winnow
from scriptorium.llm.blocks import MESSAGE, among, answer_owned, answer_recurring, ask_recurring, blocked, layout, messages, number, told_owned, told_recurring

WINDOW = 35
GRAM = 8
AUTOMATON_CHARS = 1_000_000
#: Words of passages that are compared with documents at once.
COMPARED_AT_ONCE = 1 << 20
#: Pairs of an anchor's place and a passage that holds it that are looked at at once, beside one document's own.
PAIRS_AT_ONCE = 1 << 19


def _words(table: pa.Table) -> Words:
    text = table.column("text").combine_chunks()
    return Words(*column_bytes(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text), NOT_BLANK, lower=False)


def _within(words: Words, owner: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k words lie in one document."""
    n = max(len(words) - k + 1, 0)
    return owner[:n] == owner[k - 1 :][:n]


def _anchors(words: Words, owner: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows; a document has the same in whatever order a block's rows come."""
    grams = run_hashes(words.hash, gram)
    at = np.flatnonzero(winnow(grams, window - gram + 1, _within(words, owner, window)) & _within(words, owner, gram))
    return at, grams[at]


def _near(words: Words, owner: np.ndarray, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows that hold one of the anchors."""
    hashes = run_hashes(words.hash, window)
    n = len(hashes)
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, np.clip(at - (window - gram), 0, n), 1)
    np.add.at(marks, np.clip(at + 1, 0, n), -1)
    places = np.flatnonzero((np.cumsum(marks[:-1]) > 0) & _within(words, owner, window))
    return places, hashes[places]


def _passages(words: Words, owner: np.ndarray, starts: np.ndarray, target: np.ndarray, window: int) -> list[tuple[int, bytes]]:
    """For each target the unions of touching windows of one document, a line each, their words parted by one space."""
    order = np.lexsort((starts, target))
    starts, target = starts[order], target[order]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (target[1:] != target[:-1]) | (starts[1:] > starts[:-1] + window) | (owner[starts[1:]] != owner[starts[:-1]])
    run = np.flatnonzero(fresh)
    first, size = starts[run], starts[np.append(run[1:] - 1, len(starts) - 1)] + window - starts[run]
    ends = np.cumsum(size)
    word = np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]))
    length = words.end[word] - words.start[word] + 1  # with what parts it from the next
    out = gather(np.append(words.data, np.uint8(32)), words.start[word], length)
    at = np.cumsum(length)
    out[at - 1] = 32
    out[at[ends - 1] - 1] = 10
    whose = target[run]
    last = np.flatnonzero(np.append(whose[1:] != whose[:-1], True))
    stops = at[ends[last] - 1]
    return [(int(whose[k]), out[a : b - 1].tobytes()) for k, a, b in zip(last.tolist(), [0, *stops[:-1].tolist()], stops.tolist(), strict=True)]


def _joined(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of every document joined by one space: bytes and n + 1 offsets."""
    start, size = words.start[keep], (words.end - words.start)[keep]
    rows = np.concatenate([[0], np.cumsum(keep)])[words.rows]
    last = np.zeros(len(start), bool)
    last[rows[1:][rows[1:] > rows[:-1]] - 1] = True
    length = size + ~last  # a byte more for the space, not after a document's last word
    out = gather(np.append(words.data, np.uint8(32)), start, length)
    ends = np.cumsum(length)
    out[ends[~last] - 1] = 32
    return out, np.concatenate([[0], ends])[rows]


def _automata(patterns: list[str], most: int):
    """Automata of about `most` characters each; a longer pattern has its own."""
    made, size = ahocorasick.Automaton(), 0
    for k, pattern in enumerate(patterns):
        if size and size + len(pattern) > most:
            made.make_automaton()
            yield made
            made, size = ahocorasick.Automaton(), 0
        made.add_word(pattern, (k, len(pattern)))
        size += len(pattern)
    if size:
        made.make_automaton()
        yield made


def _text(data: np.ndarray) -> str:
    return data.tobytes().decode("utf-8", "replace")


class _Part:
    """The words of rows [low, high) of a block."""

    def __init__(self, words: Words, low: int, high: int):
        a, b = words.rows[low], words.rows[high]
        self.data, self.start, self.end, self.rows = words.data, words.start[a:b], words.end[a:b], words.rows[low : high + 1] - a

    def texts(self) -> list[str]:
        """Every row's words with one space before, between and after them."""
        joined, ends = _joined(self, np.ones(len(self.start), bool))
        return [f" {_text(joined[a:b])} " for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


def _found(words: Words, patterns: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and pattern of every place in the documents at which a pattern, a space at either end, stands."""
    automata = list(_automata(patterns, most))
    places, kinds = [], []
    ends = np.concatenate([words.end, [0]])[words.rows - 1] if len(words) else words.rows  # bytes of all rows before
    ends[words.rows == 0] = 0
    for low, high in spans(ends, PIECE_BYTES):
        for row, text in enumerate(_Part(words, low, high).texts(), low):
            found = [(last - size + 1, k) for automaton in automata for last, (k, size) in automaton.iter(text)] if len(text) > 2 else []
            if found:
                blank = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
                at, kind = np.array(found).T
                places.append(words.rows[row] + np.searchsorted(blank, at))
                kinds.append(kind)
    if not places:
        return (np.zeros(0, np.int64),) * 2
    return np.concatenate(places), np.concatenate(kinds)


def _mark(gone: np.ndarray, there: np.ndarray, here: np.ndarray, low: np.ndarray, high: np.ndarray, shift: np.ndarray, window: int) -> None:
    """Adds 1 to gone where a run of `window` or more equal words of [low, high) begins, and takes it off after its end.

    A word at i is compared with the passages' word at i + shift.
    """
    cuts = np.flatnonzero(np.diff(np.cumsum(high - low) // COMPARED_AT_ONCE, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(low)], strict=False):
        size = high[a:b] - low[a:b]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(low[a:b], size) + step
        same = there[at] == here[at + np.repeat(shift[a:b], size)]
        opens = np.flatnonzero(same & ((step == 0) | ~np.concatenate([[False], same[:-1]])))
        closes = np.flatnonzero(same & np.concatenate([(step[1:] == 0) | ~same[1:], [True]]))
        enough = closes - opens + 1 >= window
        np.add.at(gone, at[opens[enough]], 1)
        np.add.at(gone, at[closes[enough]] + 1, -1)


def _located(words: Words, passages: Words, window: int, gram: int, most: int) -> np.ndarray:
    """Words of the block inside any occurrence of a window of the passages, by way of the passages' anchors."""
    gone = np.zeros(len(words) + 1, np.int64)
    if not len(passages):
        return gone[:-1] > 0
    starts, hashes, whose = passages.rows, passages.hash, passages.row_of()
    size = np.diff(starts)
    grams = run_hashes(hashes, gram)
    n = len(grams)
    at = np.flatnonzero(winnow(grams, window - gram + 1, _within(passages, whose, window)) & (whose[:n] == whose[gram - 1 :][:n]))
    by: dict[bytes, list[int]] = {}
    for k in at.tolist():
        by.setdefault(b" ".join(passages.text(i) for i in range(k, k + gram)), []).append(k)
    place, kind = _found(words, [f" {p.decode('utf-8', 'replace')} " for p in by], most)
    order = np.argsort(place, kind="stable")
    place, kind = place[order], kind[order]
    many = np.array([len(v) for v in by.values()])
    flat, base = np.concatenate([np.array(v) for v in by.values()]), np.cumsum(many) - many
    owner, span = words.row_of(), len(words) + int(size.max()) + 1
    # documents in parts of some PAIRS_AT_ONCE pairs of an anchor's place and a passage that holds it
    doc_of = owner[place]
    pairs = np.bincount(doc_of, many[kind], len(words.rows) - 1)
    part = (np.cumsum(pairs) - pairs).astype(np.int64) // PAIRS_AT_ONCE
    cuts = np.flatnonzero(np.diff(part[doc_of], prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(place)], strict=False):
        x, k = place[a:b], kind[a:b]
        times = many[k]
        own = flat[np.repeat(base[k] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        # each passage along each document once, however many of its anchors are there
        begin = np.repeat(x, times) - own + starts[whose[own]]
        key = np.unique((np.repeat(doc_of[a:b], times) * len(size) + whose[own]) * span + (begin + span - len(words) - 1))
        both, begin = np.divmod(key, span)
        begin -= span - len(words) - 1
        doc, passage = np.divmod(both, len(size))
        low, high = np.maximum(begin, words.rows[doc]), np.minimum(begin + size[passage], words.rows[doc + 1])
        long = high - low >= window
        _mark(gone, words.hash, hashes, low[long], high[long], (starts[passage] - begin)[long], window)
    return np.cumsum(gone[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """Per row of docs: id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    gram = min(gram, window)
    blocks, shards = layout(docs, text_col)
    given = blocked(docs, id_col, text_col, blocks)
    out = T.StructType([docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def ask_anchors(key, table):
        words = _words(table)
        return messages(ask_recurring(number(key), _anchors(words, words.row_of(), window, gram)[1], shards))

    def recurring_anchors(words, owner, told):
        at, prints = _anchors(words, owner, window, gram)
        return at[among(prints, told_recurring(told, prints, shards))]

    def ask_windows(key, table, told):
        if not table.num_rows:
            return messages([])
        words = _words(table)
        owner = words.row_of()
        _, hashes = _near(words, owner, recurring_anchors(words, owner, told), window, gram)
        return messages(ask_recurring(number(key), hashes, shards))

    def send(key, table, told):
        """The owned passages, to each block that asked for their windows."""
        if not table.num_rows:
            return messages([])
        words = _words(table)
        owner = words.row_of()
        # both rounds' answers lie in one table: those about windows have shards from `shards` on
        numbers = told.column("shard").to_numpy()
        about_windows = numbers >= shards
        rest = told.filter(pa.array(about_windows))
        if not rest.num_rows:
            return messages([])
        rest = rest.set_column(1, "shard", pa.array(rest.column("shard").to_numpy() - shards, pa.int32()))
        places, hashes = _near(words, owner, recurring_anchors(words, owner, told.filter(pa.array(~about_windows))), window, gram)
        known, first = np.unique(hashes, return_index=True)  # of each window its first place
        own, many, target = told_owned(rest, known, shards)
        return messages([(b, number(key), zstandard.compress(text, 1)) for b, text in _passages(words, owner, np.repeat(places[first[own]], many), target, window)])

    def cut(key, table, told):
        if not table.num_rows:
            return out_table([], [], [], None, None)
        words = _words(table)
        texts = [zstandard.decompress(p.as_py()).decode().split("\n") for p in told.column("payload")]
        passages = Words(*column_bytes(pa.array([t for each in texts for t in each], pa.large_string())), NOT_BLANK, lower=False)
        gone = _located(words, passages, window, gram, automaton_chars)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.rows])
        return out_table(table.column("id"), np.diff(words.rows), removed, *_joined(words, ~gone))

    def out_table(ids, n, removed, data, ends):
        if ends is None:
            return pa.table([pa.array([], ids_type), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], names=out.names)
        return pa.table([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), binary_rows(data, ends, pa.string())], names=out.names)

    ids_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(docs.schema[id_col].dataType.simpleString(), pa.string())
    first = given.groupBy("block").applyInArrow(ask_anchors, MESSAGE).groupBy("shard").applyInArrow(answer_recurring, MESSAGE)
    second = given.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(ask_windows, MESSAGE).groupBy("shard").applyInArrow(answer_owned, MESSAGE)
    told = first.unionByName(second.withColumn("shard", F.col("shard") + F.lit(shards)))
    sent = given.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(send, MESSAGE)
    return given.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(cut, out)
