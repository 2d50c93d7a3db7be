"""The classifier learns from whole texts, and its features do not depend on their length."""

import random

from scriptorium.llm import quality


def prose(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


def test_what_stands_late_in_training_texts_counts(spark):
    r = random.Random(1)
    vocabulary = lambda letters: ["".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(150)]
    common, good, bad = vocabulary("abcdefgh"), vocabulary("ijklmnop"), vocabulary("qrstuvwx")
    rows = [(i, prose(r, common, 3500) + " " + prose(r, good if i % 2 else bad, 3500)) for i in range(40)]
    new = [(100, prose(r, good, 500)), (101, prose(r, bad, 500))]
    docs = spark.createDataFrame(rows + new, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, model).where("doc_id >= 100").collect()}
    assert got[100] > 0.8 and got[101] < 0.2


def test_bad_blocks_of_longer_texts_are_no_worse():
    r = random.Random(2)
    good, bad = prose(r, ["alpha", "beta", "gamma"], 4000).encode(), prose(r, ["delta", "omega", "kappa"], 4000).encode()
    sizes = quality.CompressionClassifier(good[:8000], bad[:8000], (0.0, 0.0), 0.0, 0.5).sizes()
    words = ["alpha", "beta", "delta", "omega", "noise", "xyzzy"]
    text = prose(r, words, 30_000).encode()
    short = [sizes.features(memoryview(text[i : i + 6000]))[1] for i in range(0, len(text) - 6000, 6000)]
    assert abs(sizes.features(memoryview(text))[1] - sum(short) / len(short)) < 0.02
