"""Near copies go by rows: shared, null and repeated ids."""

import random

import pytest

from conftest_rows import prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_near_copies_with_shared_and_null_ids(spark):
    rng = random.Random(3)
    a, b, c, d, clean = (prose(rng, 120) for _ in range(5))
    near = lambda text, word: " ".join([word, *text.split()[1:]])
    rows = [(1, a), (2, near(a, "x")), (2, clean), (5, b), (5, near(b, "x")), (None, c), (None, near(c, "x")), (None, near(a, "y")), (7, d), (7, d), (8, None), (8, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.keep_one_near_copy(spark, docs, "").collect()]
    assert sorted((r for r in kept if r[1] is None), key=repr) == [(8, None), (8, None), (None, None)]
    assert sorted((r for r in kept if r[1] in (a, clean, d)), key=repr) == sorted([(1, a), (2, clean), (7, d)], key=repr)
    for text in (b, c):
        assert sum(r[1] in (text, near(text, "x")) for r in kept) == 1
    assert len(kept) == 8
