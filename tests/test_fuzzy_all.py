"""Whole needles in all texts, against the plain search."""

import random

import numpy as np
import pytest

from scriptorium.functions import fuzzy
from scriptorium.plans import catalogue


def texts(seed):
    """Items and documents with zero to three errors anywhere, and what candidates by words miss."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))
    items = [" ".join(word() for _ in range(r.randint(2, 30))) for _ in range(12)] + ["to be or not to be, that is it", "ab", "é", "", None]
    docs = []
    for _ in range(60):
        item = list(r.choice(items) or "xy")
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(item) + 1)
            item[at : at + r.randint(0, 1)] = r.choice(["", "z", "\n", "ü", "-"])
        docs.append(" ".join([word() for _ in range(r.randint(0, 5))]) + r.choice([" ", "\n", ",", ""]) + "".join(item) * r.randint(1, 2) + r.choice(["", ".", " " + word()]))
    return items, [*docs, "", None]


@pytest.mark.parametrize("grams", [True, False])
def test_search_of_pairs_is_search(monkeypatch, grams):
    if not grams:
        monkeypatch.setattr(fuzzy.bits, "sieved", lambda needles, texts, k: np.ones(len(needles[2]), bool))
    for seed in range(4):
        items, docs = texts(seed)
        for k in range(4):
            pairs = [(item, doc) for item in items for doc in docs if item and doc and (len(item) < 60 or seed == k)]
            for pair, hits in zip(pairs, fuzzy.search_pairs(pairs, k), strict=True):
                assert hits == fuzzy.search(*pair, k), (pair, k)


def test_search_of_long_needles_and_odd_characters():
    r = random.Random(3)
    pairs = [("", "x"), ("x", ""), ("a" * 64, "b" + "a" * 63 + "b" + "a" * 65), ("a" * 65, "a" * 64), ("\ud800é👍", "xx\ud800e👍"), ("ab" * 100, "ab" * 99 + "ba" * 3)]
    for _ in range(40):
        needle = "".join(r.choices("ab", k=r.randint(1, 200)))
        text = list("".join(r.choices("ab", k=r.randint(0, 20))) + needle + "".join(r.choices("ab", k=r.randint(0, 20))))
        for _ in range(r.randint(0, 6)):
            at = r.randrange(len(text) + 1)
            text[at : at + r.randint(0, 1)] = r.choice(["", "a", "b"])
        pairs.append((needle, "".join(text)))
    for k in (0, 2, 5):
        assert fuzzy.search_pairs(pairs, k) == [fuzzy.search(*p, k) for p in pairs]


def test_whole_items_in_all_documents(spark, tmp_path):
    items, docs = texts(7)
    items, docs = [*enumerate(items), (0, "again, under one id"), (None, docs[0])], [*enumerate(docs), (3, "again, under one id")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = [(i, a.lower(), d, b.lower()) for i, a in items for d, b in docs if a and b]
    want = [(i, d, len(m), m[0][2]) for i, a, d, b in pairs if (m := fuzzy.search(a, b, 2))]
    found = catalogue.QUERIES["fuzzy_contains_k2"](spark, str(tmp_path))
    assert sorted([tuple(r)[:4] for r in found.collect()], key=repr) == sorted(want, key=repr)
    exact = catalogue.QUERIES["fuzzy_contains_k0"](spark, str(tmp_path))
    assert sorted(map(tuple, exact.collect()), key=repr) == sorted([(i, d) for i, a, d, b in pairs if a in b], key=repr)
    many = fuzzy.search_all(spark.createDataFrame(items, "i long, n string"), "i", "n", spark.createDataFrame(docs, "d long, t string"), "d", "t", 2, block_chars=200)
    assert sorted([(r["i"], r["d"], len(r["matches"])) for r in many.collect()], key=repr) == sorted([w[:3] for w in want], key=repr)


def test_item_without_long_words_is_found(spark, tmp_path):
    spark.createDataFrame([(1, "to be or not to be, that is it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(5, "He said:\nTo be or nat to be, that is it!"), (6, "nothing")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r)[:4] for r in catalogue.QUERIES["fuzzy_contains_k2"](spark, str(tmp_path)).collect()] == [(1, 5, 1, 1)]
