"""The stored index against plain Python, and word search over long rows."""

import collections
import random

import numpy as np
import pytest

from scriptorium.operators import index, matching


@pytest.mark.parametrize("size", [1, 127, 128, 129, 5000, 65536])
def test_blocks_round_trip(size):
    rng = np.random.default_rng(size)
    places = np.sort(rng.choice(65536, size, replace=False))
    counts = rng.integers(1, 300 if size < 5000 else 3, size)
    block = index.Block(index.packed(places, counts))
    assert block.places().tolist() == places.tolist()
    assert block.counts.tolist() == counts.tolist()
    for k in (1, 40, 3000):
        wanted = np.sort(rng.choice(65536, min(k, 65536), replace=False))
        yes, count = block.among(wanted)
        known = dict(zip(places.tolist(), counts.tolist(), strict=True))
        assert yes.tolist() == [w in known for w in wanted.tolist()]
        assert count.tolist() == [known.get(w, 0) for w in wanted.tolist()]


def test_few_runs_are_decoded():
    every = np.arange(65536)
    common, rare = index.Block(index.packed(every, every % 7 + 1)), index.Block(index.packed(np.array([5, 40000]), np.array([1, 2])))
    places, counts = index.intersected([common, rare])
    assert places.tolist() == [5, 40000] and counts.tolist() == [1 + 6, 2 + 40000 % 7 + 1]
    assert common.decoded == 2


def brute(texts, queries):
    out = []
    for q, text in queries:
        wanted = set((text or "").lower().split())
        found = []
        for key, body in texts:
            held = collections.Counter((body or "").lower().split())
            if wanted and all(w in held for w in wanted):
                found.append((-sum(held[w] for w in wanted), key))
        out += [(q, key, -n, k + 1) for k, (n, key) in enumerate(sorted(found))]
    return sorted(out)


def test_index_is_reused(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(index, "SEGMENT", 16)
    rng = random.Random(3)
    known = [f"w{k}" for k in range(60)]
    texts = [(k, " ".join(rng.choices(known, weights=[1 / (i + 1) for i in range(60)], k=rng.randint(0, 40)))) for k in range(300)]
    texts += [(300, None), (301, "  "), (302, "É é\tW1"), (303, "W0 w0 w1"), (303, "w0 w1")]
    queries = [(1, "w0"), (2, "w1 W0"), (3, "w59 w0 w3"), (4, "nowhere w0"), (5, ""), (6, None), (7, "é w1"), (8, "w0 w1 w2 w3 w4")]
    made = index.build(spark.createDataFrame(texts, "key long, text string").repartition(3), "key", "text", str(tmp_path / "index"))
    asked = spark.createDataFrame(queries, "q long, text string")
    again = index.TextIndex(spark, str(tmp_path / "index"))
    want = brute(texts, queries)
    assert sorted(tuple(r) for r in index.search(made, asked, "q", "text").collect()) == want
    pages = [sorted(tuple(r) for r in index.search(again, asked, "q", "text", first, 10).collect()) for first in (1, 11, 21)]
    assert pages == [[r for r in want if first <= r[3] < first + 10] for first in (1, 11, 21)]


def test_index_of_nothing(spark, tmp_path):
    made = index.build(spark.createDataFrame([(1, None)], "key long, text string"), "key", "text", str(tmp_path / "index"))
    assert index.search(made, spark.createDataFrame([(1, "a")], "q long, text string"), "q", "text").collect() == []


def test_words_of_long_rows(spark):
    """Rows of 100,000 distinct words in a session of 4 GB."""
    rows = spark.range(6).selectExpr("id AS key", "concat_ws(' ', transform(sequence(1, 100000), k -> concat('w', k * (1 + id % 2)))) AS text")
    queries = spark.createDataFrame([(1, "w1 w99999"), (2, "w200000 w2"), (3, "w100001")], "q long, text string")
    got = sorted(tuple(r) for r in matching.token_search(queries, "q", "text", rows, "key", "text").collect())
    assert got == [(1, 0), (1, 2), (1, 4), (2, 1), (2, 3), (2, 5)]


def test_rows_that_repeat_an_id(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "a c"), (None, "a b"), (2, None), (3, "b")]
    got = matching.token_search(spark.createDataFrame([(7, "a b"), (8, "a"), (9, "")], "q long, text string"), "q", "text", spark.createDataFrame(rows, "key long, text string"), "key", "text")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([(7, 1), (7, 1), (7, None), (8, 1), (8, 1), (8, 1), (8, None)], key=repr)


def test_no_index_of_rows_is_broadcast(spark, tmp_path):
    """A file's size says nothing of its words: only the queries' distinct words may be sent to all."""
    spark.range(2000).selectExpr("id AS key", "concat('red bolt ', id % 3) AS text").write.parquet(str(tmp_path / "rows"))
    spark.createDataFrame([(1, "red 1"), (2, "bolt red"), (3, "red blue")], "q long, text string").write.parquet(str(tmp_path / "queries"))
    found = matching.token_search(spark.read.parquet(str(tmp_path / "queries")), "q", "text", spark.read.parquet(str(tmp_path / "rows")), "key", "text")
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert all("LeftSemi" in line for line in joins)
    assert sorted(tuple(r) for r in found.collect()) == [(1, k) for k in range(1, 2000, 3)] + [(2, k) for k in range(2000)]
