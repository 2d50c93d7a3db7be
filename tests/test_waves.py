"""Search in waves sees what the search in order sees, and scores less."""

import random

from pyspark.sql import functions as F

from scriptorium.functions import text
from scriptorium.operators import matching, waves


def test_waves_see_the_same(spark):
    rng = random.Random(8)
    targets = spark.createDataFrame([(k, k % 4 if k else None) for k in range(60)], "target long, block long")
    candidates = spark.createDataFrame([(k, k % 4, rng.random() * (0.75 if k % 4 else 1)) for k in range(400)], "pos long, block long, base double")
    scored = []

    def score(left, part):
        pairs = left.join(part, "block").select("target", "pos", ((F.col("base") * (1 + F.col("target") % 3) / 2)).alias("score"))
        scored.append(pairs.count())
        return pairs

    every = targets.join(candidates, "block").select("target", "pos", (F.col("base") * (1 + F.col("target") % 3) / 2).alias("score"))
    rows = lambda frame: sorted(tuple(r) for r in frame.select("target", "pos", "seen", "score").collect())
    want = rows(matching.early_exit(every, "target", "pos"))
    assert rows(waves.search(targets, candidates, "block", "target", "pos", score)) == want
    assert len(want) <= sum(scored) < 59 * 50 / 2 and len(scored) == 3
    best = waves.best(targets, candidates, "block", "target", "pos", score)
    assert sorted((r["target"], r["pos"]) for r in best.collect()) == sorted((r["target"], r["pos"]) for r in matching.best_match(every, "target", "pos").collect())


def test_bounds_leave_pairs_out(spark):
    rng = random.Random(3)
    name = lambda: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 6))) for _ in range(3))
    targets = spark.createDataFrame([(k, 0, name()) for k in range(40)], "target long, block long, a string")
    candidates = spark.createDataFrame([(k, 0, name()) for k in range(60)], "pos long, block long, b string")
    pairs = targets.join(candidates, "block").select("target", "pos", "a", "b")
    every = pairs.withColumn("score", text.ratio("a", "b") / 100).drop("a", "b")
    scored = []

    def score(worth, _):
        scored.append(worth.count())
        return worth.select("target", "pos", (text.ratio("a", "b") / 100).alias("score"))

    def bound(left, part):
        return left.join(part, "block").select("target", "pos", "a", "b", (text.ratio_bound("a", "b") / 100).alias("bound"))

    found = waves.best(targets, candidates, "block", "target", "pos", score, bound=bound)
    want = matching.best_match(every, "target", "pos")
    rows = lambda frame: sorted((r["target"], r["pos"], r["score"]) for r in frame.collect())
    assert rows(found) == rows(want)
    assert 40 * 5 < sum(scored) < 0.8 * 40 * 50


def test_bounds_hold_and_ratios_are_right(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abé 日𝔘", k=n))
    rows = [(word(rng.randint(0, 90)), word(rng.randint(0, 90))) for _ in range(300)] + [("a" * 64, "a" * 64), ("a" * 63, "a" * 70), ("a" * 65, "a" * 66), (None, "x"), ("x", None), ("", "")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", text.ratio("a", "b").alias("r"), text.ratio_bound("a", "b").alias("most")).collect()
    assert [r["r"] for r in got] == [text.indel_ratio(a, b) for a, b in rows]
    assert all(r["most"] >= r["r"] for r in got) and any(r["most"] < 60 for r in got if r["a"] and r["b"])
