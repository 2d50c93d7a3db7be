"""A bounded memory of word encodings, kept by a Python worker between chunks and tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from scriptorium.llm.arrays import gather

#: Words a worker remembers; a word takes some 40 bytes. Past it the memory starts afresh.
MOST_WORDS = 1_000_000


class WordMemory:
    """Word hash -> run of integers, in sorted arrays."""

    def __init__(self, most: int = MOST_WORDS):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.int32)

    def find(self, keys: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Start in the pool and length for each of the ascending, distinct keys.

        encode(places) gives the values, end to end, and lengths of the keys at
        places that are not known yet.
        """
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        missing = np.flatnonzero(~known)
        if len(missing):
            if len(self.keys) + len(missing) > self.most and len(self.keys):
                self.clear()
                return self.find(keys, encode)
            values, lengths = encode(missing)
            start = len(self.pool) + np.cumsum(lengths) - lengths
            where = np.searchsorted(self.keys, keys[missing])
            self.start = np.insert(self.start, where, start)
            self.length = np.insert(self.length, where, lengths)
            self.keys = np.insert(self.keys, where, keys[missing])
            self.pool = np.concatenate([self.pool, values.astype(np.int32)])
            at = np.searchsorted(self.keys, keys)
        return self.start[at], self.length[at]

    def expand(self, hashes: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Values of all words, end to end, and the length of each; encode gets places in `hashes`."""
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        start, length = self.find(keys, lambda places: encode(first[places]))
        length = length[back]
        return gather(self.pool, start[back], length), length
