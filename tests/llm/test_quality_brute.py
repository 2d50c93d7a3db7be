"""Dictionaries, features and curve of the compression classifier, worked out again."""

import random

import numpy as np
import pytest
import zstandard
from conftest_rows import messy_rows, prose
from pyspark.sql import functions as F

from scriptorium.llm import quality

BLOCK, LEVEL, DICTIONARY = 512, 3, 112_640


def corpus():
    rng = random.Random(9)
    docs = [(i, " ".join(w + ("$$" if i % 3 == 0 and rng.random() < 0.5 else "") for w in prose(rng, rng.randint(20, 900)).split())) for i in range(400)]
    return docs + [(1000 + k, t) for k, (_, t) in enumerate(messy_rows())]


def by_hand(model, text):
    """The two features of one text."""
    data = (text or "").encode()
    n = max(1, len(data) // BLOCK)
    parts = [data[i * len(data) // n : (i + 1) * len(data) // n] for i in range(n)]
    size = {}
    for name, raw in (("good", model.good), ("bad", model.bad)):
        size[name] = [len(zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_dict_id=False, write_checksum=False).compress(p)) for p in parts]
    g, b = sum(size["good"]), sum(size["bad"])
    each = [(y - x) / (y + x) for x, y in zip(size["good"], size["bad"], strict=True)]
    return (b - g) / (b + g), float(np.quantile(each, 0.1))


def test_all_of_it(spark):
    docs = corpus()
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string").repartition(3)
    marks = [(i, int(i % 3 != 0)) for i in range(0, 400, 2)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    model = quality.fit(frame, labels, sample=60)
    order = [r["doc_id"] for r in labels.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), "doc_id").collect()]
    text, label = dict(docs), dict(marks)
    chosen = {k: [i for i in order if label[i] == k][:60] for k in (0, 1)}
    for k, made in ((1, model.good), (0, model.bad)):
        parts = [t[j : j + BLOCK] for i in chosen[k][::2] for t in [text[i].encode()] for j in range(0, len(t), BLOCK)]
        assert made == zstandard.train_dictionary(DICTIONARY, parts, level=LEVEL).as_bytes()
    rest = [(i, k) for k in (0, 1) for i in chosen[k][1::2]]
    x = np.array([by_hand(model, text[i]) for i, _ in rest])
    y = np.array([k for _, k in rest], float)
    weight = np.array([sum(v == k for v in label.values()) / len(chosen[k][1::2]) for _, k in rest])
    weight *= len(weight) / weight.sum()
    slopes, scale = np.array(model.slopes), x.std(0)
    p = 1 / (1 + np.exp(-(x @ slopes + model.intercept)))
    # at the least weighted log loss, with a ridge of 1e-3 on the slopes of scaled features, nothing pulls
    assert np.abs((x / scale).T @ (weight * (y - p)) - 1e-3 * slopes * scale).max() < 1e-6
    assert abs((weight * (y - p)).sum()) < 1e-6
    got = quality.score_documents(frame, model).select("doc_id", "text", "score").collect()
    assert len(got) == len(docs)
    for r in got:
        want = 1 / (1 + np.exp(-(np.array(by_hand(model, r["text"])) @ slopes + model.intercept))) if r["text"] else sum(label.values()) / len(label)
        assert r["score"] == pytest.approx(want, abs=1e-12)


def test_few_short_texts_serve_whole(spark):
    texts = [(i, ("good " if i % 2 else "bad ") * (20 + i)) for i in range(16)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(16)], "doc_id long, quality int")
    model = quality.fit(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    order = [r["doc_id"] for r in labels.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), "doc_id").collect()]
    for k, made in ((1, model.good), (0, model.bad)):
        assert made == "".join(dict(texts)[i] for i in [i for i in order if i % 2 == k][::2]).encode()


def test_texts_beyond_the_bytes_are_left_out(spark):
    docs = [(i, prose(random.Random(i), 100) + ("$" * 50 if i % 2 else "")) for i in range(60)] + [(100, "z" * 200_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, 1)], "doc_id long, quality int")
    model = quality.fit(frame, marks, sample_bytes=100_000)
    assert b"z" * 100 not in model.good and model.slopes != (0.0, 0.0)


def test_a_fit_over_nothing(spark, nothing):
    model = quality.fit(nothing, spark.createDataFrame([], "doc_id long, quality int"))
    assert model.share == 0.5 and quality.score_documents(nothing, model).collect() == []
    labelled = quality.fit(nothing, spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int"))
    assert labelled.share == pytest.approx(2 / 3)
