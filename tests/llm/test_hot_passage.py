"""A passage that thousands of items share, in thousands of documents."""

import time

import brute
import numpy as np
import pyarrow as pa

from scriptorium.llm import decontaminate
from scriptorium.llm.arrays import ALNUM, Words, column_bytes


def test_passage_of_all_items(spark):
    passage = " ".join(f"shared{k}" for k in range(20))
    items = spark.range(5000).selectExpr("id AS item_id", f"concat('own', id, ' before ', '{passage}', ' after', id, ' it') AS text")
    docs = spark.range(5000).selectExpr("id AS doc_id", f"concat('document ', id, ' says {passage} end') AS text").repartition(4)
    decontaminate.contamination(docs.limit(1), items).collect()
    began = time.perf_counter()
    got = decontaminate.contamination(docs, items).selectExpr("count(*) AS n", "sum(n_hit) AS hit", "sum(size(items)) AS items").first()
    assert tuple(got) == (5000, 5000 * 20, 5000 * 5000)
    assert time.perf_counter() - began < 20


def test_equal_hashes_of_unequal_windows(monkeypatch):
    """Windows are told apart by bytes where their hashes are the same."""
    monkeypatch.setattr(decontaminate, "run_hashes", lambda words, k: np.zeros(max(0, len(words) - k + 1), np.uint64))
    docs = [(1, "a b c d e f g h i j k"), (2, "b b c d e f g h i j k l"), (3, "x y"), (4, "zz")]
    bench = [("p", "a b c d e f g h i j"), ("q", "b c d e f g h i j k"), ("r", "x y"), ("s", "y x"), (None, "zz")]
    made = decontaminate.Benchmark([i for i, _ in bench], [t for _, t in bench], 10, 5)
    data, offs = column_bytes(pa.array([t for _, t in docs]))
    words = Words(data, offs, ALNUM, lower=True)
    first, length, sets = made.hits(words)
    owner = words.row_of()
    found = [sorted({i for p, x in zip(first, sets, strict=True) if owner[p] == d for i in made.items_of((int(x),))}) for d in range(len(docs))]
    covered = [len({k for p, n in zip(first, length, strict=True) if owner[p] == d for k in range(p, p + n)}) for d in range(len(docs))]
    want = brute.contamination(docs, bench)
    assert [(h, i) for h, i in zip(covered, found, strict=True)] == [(h, [x for x in i if x != "None"]) for _, h, i in want]
