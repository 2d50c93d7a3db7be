"""The pipeline over a small corpus, against its stages worked out by hand."""

import random

import numpy as np
import public_tokenizers
import pytest

import brute
from conftest_rows import prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("corpus"), random.Random(11)
    bench = [(i, prose(rng, 30)) for i in range(3)]
    good = [(i, prose(rng, rng.randint(60, 200))) for i in range(200)]
    bad = [(200 + i, " ".join(w + "$$$" for w in prose(rng, 120).split())) for i in range(60)]
    copies = [(300 + i, good[i][1].replace(" ", "  \n", 1)) for i in range(10)]
    near = [(400 + i, " ".join(["new", *good[20 + i][1].split()[1:]])) for i in range(10)]
    dirty = [(500 + i, prose(rng, 80) + " " + bench[i][1].replace(" ", ", ") + " " + prose(rng, 20)) for i in range(3)]
    docs = good + bad + copies + near + dirty
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    marks = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), dict(docs), {i for i, _ in bad}, {i for i, _ in dirty}


def test_pipeline(spark, corpus):
    from tokenizers import Tokenizer

    folder, docs, bad, dirty = corpus
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    left = [(i, t) for i, t in docs.items() if i not in bad]
    left = [r for r in left if r[0] in {x[0] for x in brute.exact(left) if x[3]}]
    left = [r for r in left if r[0] in {x[0] for x in brute.components(left, 5, 80) if x[0] == x[2]}]
    assert set(found) == {i for i, _ in left} - dirty
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in found.items():
        assert np.frombuffer(r["ids"], "<u4").tolist() == tokenizer.encode(docs[i], add_special_tokens=False).ids
        assert r["text"] == docs[i]


def test_stages_keep_the_columns(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, corpus[0]).schema.simpleString() == docs.schema.simpleString()


def test_stages_of_nothing(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus[0]).count() == 0
