"""Passages are confirmed once, by one owner, and only automata know where they stand."""

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest_rows import messy_rows

from scriptorium.llm import blocks, substrings
from scriptorium.llm.arrays import NOT_BLANK, Words, column_bytes


def words_of(texts):
    return Words(*column_bytes(pa.array(texts)), NOT_BLANK, lower=False)


@pytest.mark.parametrize("window", [5, 35])
@pytest.mark.parametrize("size", [1000, 20_000])
def test_many_blocks_and_shards(spark, messy, monkeypatch, window, size):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    monkeypatch.setattr(blocks, "SHARD_BYTES", size * 3)
    got = substrings.remove_repeats(messy, window=window, automaton_chars=3000)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute.repeats(messy_rows(), window)


def test_without_automata_nothing_is_found(monkeypatch):
    shared = " ".join(f"w{k}" for k in range(12))
    docs, passages = words_of([f"a b {shared} c", "x y z", f"{shared} {shared}"]), words_of([shared])
    assert substrings._located(docs, passages, 6, 3, 1000).sum() == 36
    monkeypatch.setattr(substrings, "_found", lambda words, patterns, most: (np.zeros(0, np.int64),) * 2)
    assert substrings._located(docs, passages, 6, 3, 1000).sum() == 0


def test_one_owner_for_each_key():
    keys = {3: [5, 9, 1 << 63], 7: [9, 1 << 63], 8: [4, 9]}
    shards = 2
    asked = [m for b, k in keys.items() for m in blocks.ask_recurring(b, np.array(k + ([4] if b == 8 else []), np.uint64), shards)]
    answers = []
    for s in range(shards):
        table = blocks.messages([m for m in asked if m[1] == s])
        if table.num_rows:
            answers += blocks.answer_owned((s,), table).to_pylist()
    told = {}
    for b, k in keys.items():
        own = [(r["block"], r["shard"], r["payload"]) for r in answers if r["block"] == b]
        known = np.unique(np.array(k, np.uint64))
        places, many, targets = blocks.told_owned(blocks.messages(own), known, shards)
        for p, t in zip(places, np.split(targets, np.cumsum(many)[:-1]) if len(many) else [], strict=True):
            told[int(known[p])] = (b, t.tolist())
    assert told == {9: (3, [3, 7, 8]), 1 << 63: (3, [3, 7]), 4: (8, [8])}


def test_passages_of_each_target():
    words = words_of(["a b c d e f g", "h i"])
    owner = words.row_of()
    got = substrings._passages(words, owner, np.array([0, 1, 3, 0, 4]), np.array([7, 7, 9, 9, 9]), 3)
    assert got == [(7, b"a b c d"), (9, b"a b c d e f g")]
    assert substrings._passages(words, owner, np.array([0, 4]), np.array([1, 1]), 3) == [(1, b"a b c\ne f g")]


def test_anchors_do_not_depend_on_the_order_of_rows():
    """A block's rows come in another order each time a shuffle is read; what it asks must be the same."""
    texts = [t or "" for _, t in messy_rows()]
    rng = np.random.default_rng(2)
    keys = []
    for _ in range(5):
        words = words_of([texts[k] for k in rng.permutation(len(texts))])
        owner = words.row_of()
        at, prints = substrings._anchors(words, owner, 12, 4)
        _, near = substrings._near(words, owner, at[prints % np.uint64(3) == 0], 12, 4)
        keys.append((np.unique(prints).tolist(), np.unique(near).tolist()))
    assert all(k == keys[0] for k in keys)
