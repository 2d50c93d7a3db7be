"""Token counts of a unigram tokenizer, without its tokens.

Per distinct word an Aho-Corasick automaton names every vocabulary piece that
ends at each character.  The best path to a character carries its score and
number of pieces only.  Ties go as in the tokenizers library: a path replaces
another only with a strictly better score, and starts are tried from the left;
a character that is no piece itself may be an unknown, ten below the worst
score, and neighbouring unknowns count as one piece.

Words are `[^\\x20\\x09-\\x0D]+`, each with the mark U+2581 before it.  Null texts
are empty and have no pieces.  Texts of any length are counted whole; a word is one
search, so time and memory grow with the longest word and not with its text.  Rows
repeat as they come in, null ids included; an empty table gives an empty result;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.arrays import NOT_BLANK, Words, chunks
from scriptorium.llm.cache import WordMemory

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a vocabulary: a tokenizers file (.json) with a unigram model, or a sentencepiece file.

    Control and byte pieces are no text.  Of a tokenizers file the model alone is
    read, so its normaliser must be none; one with byte fallback is refused, as it
    has no unknowns.
    """
    if path.endswith(".json"):
        held = json.loads(Path(path).read_text(encoding="utf-8"))
        model = held["model"]
        if model.get("type") != "Unigram" or model.get("byte_fallback") or held.get("normalizer"):
            raise ValueError("only a unigram model without byte fallback and normaliser can be counted by")
        special = {x["content"] for x in held.get("added_tokens") or []}
        return [(p, float(s)) for k, (p, s) in enumerate(model["vocab"]) if k != model.get("unk_id") and p not in special]

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = re.compile(r"<0x[0-9A-F]{2}>|<unk>|<s>|</s>")
    return [(p, model.get_score(i)) for i in range(model.get_piece_size()) if not odd.fullmatch(p := model.id_to_piece(i))]


class UnigramCounter:
    def __init__(self, vocab: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.memory = WordMemory()

    def count(self, word: str) -> int:
        """Number of pieces on the best path."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, piece in self.automaton.iter(word):
            ends[last + 1].append(piece)
        score, count, open_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for i in range(1, n + 1):
            best, at, single = None, 0, False
            for size, s in sorted(ends[i], reverse=True):  # longest first: starts from the left
                single |= size == 1
                if best is None or s + score[i - size] > best:
                    best, at = s + score[i - size], i - size
            if not single and (best is None or self.unknown + score[i - 1] > best):
                score[i], count[i], open_unknown[i] = self.unknown + score[i - 1], count[i - 1] + (not open_unknown[i - 1]), True
            else:
                score[i], count[i] = best, count[at] + 1
        return count[n]

    def counts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Number of pieces of each text of a chunk."""
        words = Words(data, offs, NOT_BLANK, lower=False)

        def fresh(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found = [self.count(MARK + words.text(i).decode("utf-8", "replace")) for i in places]
            return np.array(found, np.int32), np.ones(len(places), np.int32)

        each, _ = self.memory.expand(words.hash, fresh)
        return np.concatenate([[0], np.cumsum(each, dtype=np.int64)])[words.rows]


@lru_cache(4)
def unigram_counter(path: str) -> UnigramCounter:
    return UnigramCounter(pieces(path))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and n_tokens (long) for every row."""

    def run(batches):
        counter = unigram_counter(path)
        for rows, data, offs in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(counter.counts(data, offs)), pa.int64())], names=[id_col, "n_tokens"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())]))
