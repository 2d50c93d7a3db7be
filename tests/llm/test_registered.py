"""Registered queries without SQL, and the pipeline's stages, over rows that try everything."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

import brute
from conftest_rows import messy_rows, prose
from scriptorium.llm import quality, queries, unigram

ROWS = messy_rows()


@pytest.fixture(scope="module")
def tables(messy, spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    messy.withColumnRenamed("score", "chance of label 1").withColumnRenamed("node", "row key").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(0, 90, 3)] + [(3, 0, 0), (None, 1, 0), (6, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ROWS[30][1])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op3_rows(spark, tables):
    tokenizer, want = library("byte_bpe_50k.json"), []
    for i, text in ROWS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tokenizer.decode(ids, skip_special_tokens=False).encode())))
    frame = queries.op3_byte_bpe(spark, tables)
    assert frame.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert got(frame) == sorted(want, key=repr)


def best_path(text, scores, longest):
    """Pieces of one word's best path, character by character; neighbouring unknowns are one."""
    least = min(scores.values()) - 10
    best = [(0.0, 0, False)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - longest), end):
            piece = text[start:end]
            unknown = piece not in scores
            if unknown and end - start > 1:
                continue
            before = best[start]
            total = before[0] + (least if unknown else scores[piece])
            if best[end] is None or total > best[end][0]:
                best[end] = (total, before[1] + (not (unknown and before[2])), unknown)
    return best[-1][1]


def test_op4_rows(spark, tables):
    scores = dict(unigram.pieces(public_tokenizers.path("piece_bpe_32k.model")))
    longest = max(map(len, scores))
    words = {w: best_path("▁" + w, scores, longest) for _, t in ROWS for w in brute.words(t) if len(w) < 400}
    small = [(i, t) for i, t in ROWS if all(len(w) < 400 for w in brute.words(t))]
    frame = queries.op4_unigram_token_count(spark, tables).select("doc_id", "n_tokens")
    want = sorted(((i, sum(words[w] for w in brute.words(t))) for i, t in small), key=repr)
    long = {i for i, t in ROWS} - {i for i, t in small}
    assert frame.count() == len(ROWS)
    assert [r for r in got(frame) if r[0] not in long] == want


def test_op8_rows(spark, tables):
    tokenizer, made = library("word_bpe_49k.json"), {}
    for i, text in ROWS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        made.setdefault(i, []).append((len(ids), brute.zlib.crc32(np.array(ids, "<u4").tobytes())))
    frame = queries.op8_token_files(spark, tables)
    assert frame.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows, at = sorted(frame.collect(), key=lambda r: r["start"]), 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in ROWS), key=brute.null_first)
    assert {i: sorted((r["n_tokens"], r["ids_crc32"]) for r in rows if r["doc_id"] == i) for i in made} == {i: sorted(x) for i, x in made.items()}


def test_op5_rows(spark, tables):
    frame = queries.op5_compression_quality(spark, tables)
    rows = frame.collect()
    assert frame.columns == ["doc_id", "held_out", "score", "predicted"]
    assert sorted((r["doc_id"] for r in rows), key=brute.null_first) == sorted((i for i, _ in ROWS), key=brute.null_first)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and brute.crc(r["doc_id"], 5) == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    of = {r["doc_id"]: r["score"] for r in rows}
    assert of[40] == of[41]  # null and empty


def test_labels_that_repeat_or_contradict(spark):
    """A document labelled both ways counts as 0; rows that repeat, and a very long text, are read."""
    rng = random.Random(4)
    docs = [(i, " ".join(w + ("$$$" if i % 2 else "") for w in prose(rng, 150).split())) for i in range(80)]
    docs += [(2, docs[2][1])] * 3 + [(90, prose(rng, 60_000)), (91, " ".join(w + "$$$" for w in prose(rng, 60_000).split()))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = [(i, 1 - i % 2) for i in range(60)] + [(i, 1) for i in range(1, 60, 2)]  # every bad one is also called good
    both = quality.fit(frame, spark.createDataFrame(marks, "doc_id long, quality int"))
    score = {r["doc_id"]: r["score"] for r in quality.score_documents(frame, both).collect()}
    assert all((score[i] >= 0.3) == (i % 2 == 0) for i in range(60, 80))
    assert score[90] >= 0.3 > score[91]


def test_stages_of_rows_that_try_everything(spark, tables):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = {name: stage(spark, docs, tables) for name, stage in corpus_pipeline.STAGES}
    for frame in list(stages.values())[:-1]:
        assert frame.columns == docs.columns
    scored = quality.score_documents(docs.select("doc_id", "text"), quality.fit(docs, spark.read.parquet(f"{tables}/labels.parquet")))
    good = _counted(r["doc_id"] for r in scored.where("score >= 0.3").collect())
    assert _counted(i for i, _ in got(stages["compression classifier"].select("doc_id", "text"))) == good
    kept = _counted(x[0] for x in brute.exact(ROWS) if x[3])
    assert _counted(i for i, _ in got(stages["exact dedup"].select("doc_id", "text"))) == kept
    clean = [(i, t) for (i, t), (_, hit, _) in zip(ROWS, brute.contamination(ROWS, [(1, None), (2, ROWS[30][1])]), strict=True) if not hit]
    assert got(stages["winnowing decontamination"].select("doc_id", "text")) == sorted(clean, key=repr)
    near = got(stages["n-gram Jaccard join"].select("doc_id", "text"))
    wordless = [(i, t) for i, t in ROWS if not brute.words(t)]
    groups = {c for _, n, c in brute.components([(k, t) for k, (_, t) in enumerate(ROWS)], 5, 80) if n}
    assert len(near) == len(groups) + len(wordless)
    assert set(near) <= set(ROWS) and all(_counted(near)[r] == n for r, n in _counted(wordless).items())
    coded = got(stages["byte-level BPE"].select("doc_id", "text"))
    assert coded == sorted(((i, t or "") for i, t in ROWS), key=repr)


def _counted(items):
    out = {}
    for x in items:
        out[x] = out.get(x, 0) + 1
    return out
