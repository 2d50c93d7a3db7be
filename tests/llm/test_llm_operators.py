import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from conftest_rows import messy_rows
from scriptorium.llm import arrays, blocks, bpe, chat, decontaminate, exact, jaccard, lm, quality, queries, substrings, tokenfile, unigram

ROWS = messy_rows()


@pytest.fixture(params=["one block", "many blocks"])
def sizes(request, monkeypatch):
    """The same results from one block and shard, and from many."""
    if request.param == "many blocks":
        monkeypatch.setattr(blocks, "BLOCK_BYTES", 15_000)
        monkeypatch.setattr(blocks, "SHARD_BYTES", 40_000)
        monkeypatch.setattr(lm, "SHARD_BYTES", 40_000)
        monkeypatch.setattr(jaccard, "SLICE", 2)
        monkeypatch.setattr(jaccard, "DEAL", 2)
    return request.param


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


# --- benchmark decontamination -------------------------------------------------

BENCH = [(1, None), (2, ""), (3, " ".join(ROWS[0][1].split()[:25])), (10, "one"), (4, "A, B. c"), (5, "never anywhere " * 9), (6, "zz"), (3, "don't don't"), (7, ROWS[94 - 94 + 30][1])]


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_contamination_is_brute_force(spark, messy, block_words):
    bench = spark.createDataFrame(BENCH, "item_id long, text string").withColumn("text2", F.lit("x"))
    found = decontaminate.contamination(messy, bench, block_words=block_words)
    got = rows(found, "doc_id", "n_words", "n_hit", F.array_join("items", ","))
    want = sorted(((i, n, h, ",".join(items)) for (i, _), (n, h, items) in zip(ROWS, brute.contamination(ROWS, BENCH), strict=True)), key=repr)
    assert got == want
    assert any(r[2] for r in got)


def test_contamination_of_nothing(spark, nothing, messy):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(messy, none).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(nothing, spark.createDataFrame(BENCH, "item_id long, text string")).count() == 0


def test_carried_columns(spark, messy):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontaminate.contamination(messy, bench, carry=True).select("row.*").columns == messy.columns


@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 8))
@settings(max_examples=60, deadline=None)
def test_every_window_keeps_its_minimum(values, width):
    grams = np.array(values, np.uint64)
    keep = arrays.winnow(grams, width)
    for a in range(len(grams) - width + 1):
        least = grams[a : a + width].min()
        assert all(keep[a + k] for k in range(width) if grams[a + k] == least)


# --- language model -------------------------------------------------------------


def test_scores_are_brute_force(messy, sizes):
    train = [i is not None and i % 3 != 0 for i, _ in ROWS]
    scored = lm.score_corpus(messy.withColumn("learn", F.col("doc_id") % 3 != 0), "learn", bits=16)
    got = rows(scored, "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = sorted(((i, *x) for (i, _), x in zip(ROWS, brute.bigram_scores(ROWS, train, lm.PRIOR), strict=True)), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[4] == pytest.approx(w[4], rel=1e-9)
        assert g[5] == pytest.approx(w[5], rel=1e-3)


def test_scores_of_the_query_are_within_its_code_book(spark, messy, tmp_path):
    """The registered query with its 8 bits: a probability is off by one step of the code book at most."""
    messy.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(queries.QUERIES["op2_ngram_trie_score"](spark, str(tmp_path)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    held = [i is not None and brute.crc(i, 7) == 2 for i, _ in ROWS]
    train = [i is not None and not h for (i, _), h in zip(ROWS, held, strict=True)]
    want = sorted(((i, h, *x) for (i, _), h, x in zip(ROWS, held, brute.bigram_scores(ROWS, train, lm.PRIOR), strict=True)), key=repr)
    step = np.log10(sum(len((t or "").split()) + 1 for _, t in ROWS) + lm.PRIOR) / 254
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert abs(g[6] - w[6]) <= g[2] * step


def test_heavy_contexts_are_spread(messy, monkeypatch):
    frame = messy.withColumn("learn", F.lit(True))
    plain = rows(lm.score_corpus(frame, "learn", bits=16), "doc_id", "n_tokens", "score")
    monkeypatch.setattr(lm, "HEAVY", 3)
    monkeypatch.setattr(lm, "SHARD_BYTES", 10_000)
    for a, b in zip(rows(lm.score_corpus(frame, "learn", bits=16), "doc_id", "n_tokens", "score"), plain, strict=True):
        assert a[:2] == b[:2]
        assert a[2] == pytest.approx(b[2], rel=1e-3)


def test_no_text_to_learn_from(messy, nothing):
    scored = lm.score_corpus(messy.withColumn("learn", F.lit(None).cast("boolean")), "learn")
    assert scored.where("n_known > 0 or train_tokens > 0 or score >= 0 is null").count() == 0
    assert lm.score_corpus(nothing.withColumn("learn", F.lit(True)), "learn").count() == 0


@given(st.lists(st.integers(0, 2**40), min_size=1, max_size=200), st.lists(st.integers(0, 2**41), max_size=40))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values, asked):
    values = np.array(sorted(values), np.uint64)
    kept = lm.EliasFano.build(values)
    assert kept.access(np.arange(len(values))).tolist() == values.tolist()
    x = np.array(asked + values.tolist(), np.uint64)
    at, same = kept.successor(x)
    assert at.tolist() == np.searchsorted(values, x).tolist()
    assert same.tolist() == np.isin(x, values).tolist()


def test_trie_on_disk(tmp_path):
    rng = np.random.default_rng(3)
    pairs = np.unique(rng.integers(0, 300, (4000, 2)), axis=0)
    q = rng.random(len(pairs))
    lm.BigramTrie.build(pairs[:, 0], pairs[:, 1], q, 12).save(f"file://{tmp_path}/t")
    trie = lm.BigramTrie.open(f"file://{tmp_path}/t")
    assert isinstance(trie.successors.high, np.memmap)
    assert np.allclose(trie.book[trie.find(pairs[:, 0], pairs[:, 1])], q, rtol=5e-3)
    others = rng.integers(0, 400, (2000, 2))
    known = {tuple(p) for p in pairs.tolist()}
    assert (trie.find(others[:, 0], others[:, 1]) > 0).tolist() == [tuple(o) in known for o in others.tolist()]


# --- BPE, token counts, token files -----------------------------------------------


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_bpe_is_the_library(spark, messy):
    path = public_tokenizers.path("byte_bpe_50k.json")
    more = spark.createDataFrame([(200, "a<|endoftext|>b <|endoftext|><|endoftext|>"), (201, "<|endof"), (202, "text|> '"), (203, "'s'S'LL 'll  're\n\n 'x"), (204, "x　　y\u2028 z\u0085")], "doc_id long, text string")
    both = messy.select("doc_id", "text").unionByName(more)
    tokenizer = library("byte_bpe_50k.json")
    want = []
    for i, text in ROWS + [tuple(r) for r in more.collect()]:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), tokenizer.decode(ids, skip_special_tokens=False)))
    got = bpe.encode_documents(both, path)
    assert rows(got, "doc_id", F.sha2("ids", 256), "decoded") == sorted(want, key=repr)


@given(st.text(alphabet=st.sampled_from("ab 'sltrevmd1２\t\n\u00a0é日,."), max_size=60))
@settings(max_examples=150, deadline=None)
def test_any_text_encodes_as_the_library(text):
    own, data = bpe.byte_bpe(public_tokenizers.path("byte_bpe_50k.json")), np.frombuffer(text.encode(), np.uint8)
    ids, _ = own.encode(data, np.array([0, len(data)]))
    assert ids.tolist() == library_once().encode(text, add_special_tokens=False).ids


_held = []


def library_once():
    if not _held:
        _held.append(library("byte_bpe_50k.json"))
    return _held[0]


def test_bpe_of_nothing(nothing):
    assert bpe.encode_documents(nothing, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_counts_are_the_library(messy, nothing):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    vocab = unigram.pieces(path)
    # the library's unknown is ten below its worst score, so the stand-in for it must not lower that
    tokenizer = Tokenizer(models.Unigram([*vocab, ("\0", 0.0)], len(vocab), False))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"[\x20\x09-\x0D]+"), "removed"), pre_tokenizers.Metaspace("▁", "always", False)])
    want = sorted(((i, len(tokenizer.encode((t or "").replace("\0", ""), add_special_tokens=False).ids)) for i, t in ROWS), key=repr)
    given_rows = messy.withColumn("text", F.translate("text", "\0", ""))
    assert rows(unigram.count_tokens(given_rows, path), "doc_id", "n_tokens") == want
    assert unigram.count_tokens(nothing, path).count() == 0


def test_a_unigram_file_counts_as_the_library(tmp_path, spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = [("<unk>", 0.0), ("▁", -3.0), ("▁a", -2.5), ("ab", -2.0), ("b", -2.2), ("▁ab", -4.5), ("c", -4.0), ("bc", -6.2), ("é", -3.0)]
    tokenizer = Tokenizer(models.Unigram(vocab, 0, False))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    tokenizer.save(f"{tmp_path}/t.json")
    texts = ["ab abc", "a", "xxab é?", "bcbc abab cc", "b ?? a"]
    got = unigram.count_tokens(spark.createDataFrame([*enumerate(texts)], "doc_id int, text string"), f"{tmp_path}/t.json")
    assert rows(got, "doc_id", "n_tokens") == [(k, len(tokenizer.encode(t).ids)) for k, t in enumerate(texts)]
    with pytest.raises(ValueError):
        unigram.pieces(public_tokenizers.path("word_bpe_49k.json"))


def test_a_tokenizer_that_minds_spaces_gets_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a b  c", "", "x\ny"]
    data = "".join(texts).encode()
    ids, at = tokenfile.encode_chunk(path, np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, texts)]))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library("byte_bpe_50k.json").encode(t).ids for t in texts]
    assert tokenfile._encoder(public_tokenizers.path("word_bpe_49k.json"))[2] and not tokenfile._encoder(path)[2]


def test_equal_scores_take_the_longest_piece_first():
    counter = unigram.UnigramCounter([("ab", -2.0), ("a", -1.0), ("b", -1.0), ("▁", -1.0)])
    assert counter.count("▁ab") == 2
    assert counter.count("▁a??b") == 4
    assert counter.count("") == 0


def test_token_files(messy, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, want, at = library("word_bpe_49k.json"), [], 0
    for i, text in sorted(ROWS, key=lambda r: (brute.null_first(r[0]), r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, len(ids), brute.zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    manifest = tokenfile.write_token_files(messy, path, 2)
    got = tokenfile.read_token_files(manifest).orderBy("start").collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=brute.null_first)
    some = tokenfile.find_documents(manifest, [95, 3, 7, 12_345]).collect()
    ids_of = lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
    assert sorted((r["doc_id"], r["ids"]) for r in some) == sorted((i, ids_of(t)) for i, t in ROWS if i in (95, 3, 7))
    with pytest.raises(ValueError):
        tokenfile.write_token_files(messy.withColumn("doc_id", F.col("doc_id").cast("string")), path, 2)
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(len(got))]
    assert tokenfile.read_token_files(tokenfile.write_token_files(nothing, path, 2)).count() == 0


def test_random_access_and_damage():
    import io

    sink = io.BytesIO()
    writer = tokenfile.TokenFileWriter(sink, wide=False)
    sizes = np.array([3, 70_000, 1, 40_000, 40_000])
    writer.add([1, 2, None, 4, 5], sizes, np.arange(sizes.sum()) % 50_000)
    writer.close()
    data = sink.getvalue()
    reader = tokenfile.TokenFileReader(io.BytesIO(data), len(data))
    whole = np.arange(sizes.sum()) % 50_000
    for k in (4, 0, 2, 1, 3):
        a = sizes[:k].sum()
        assert reader.document(k).tolist() == whole[a : a + sizes[k]].tolist()
    assert len(reader.frames) == 4
    bad = bytearray(data)
    bad[int(reader.at[1]) + 40] ^= 1
    with pytest.raises((ValueError, tokenfile.zstandard.ZstdError)):
        tokenfile.TokenFileReader(io.BytesIO(bytes(bad)), len(bad)).document(1)


# --- quality ------------------------------------------------------------------------


def test_quality_tells_kinds_apart(spark, nothing):
    import random

    from conftest_rows import prose

    rng = random.Random(2)
    docs = [(i, " ".join(w + ("$$$" if i % 4 == 0 else "") for w in prose(rng, 120).split())) for i in range(400)] + [(1000, None), (1001, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(frame, labels, sample=60)
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(frame, model).collect()}
    held = [i for i in range(300, 400)]
    assert sum((got[i] >= 0.3) == (i % 4 != 0) for i in held) >= 98
    assert got[1000] == got[1001] == pytest.approx(0.75, abs=0.02)
    assert all(0 <= s <= 1 for s in got.values())
    none = quality.fit(frame, labels.where("false"))
    assert {r["score"] for r in quality.score_documents(frame, none).collect()} == {0.5}
    assert quality.score_documents(nothing, model).count() == 0


# --- chat ---------------------------------------------------------------------------

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a\\b <|im_end|>"), (1, 2, "user", "\\<|\n"), (1, 3, "assistant", "<|im_start|>assistant ok\\"),
    (2, 0, "assistant", "first"), (3, 1, "system", None), (3, 1, "system", None), (3, None, None, "x"), (None, 0, "user", ""), (None, 1, "assistant", "é👍"), (4, 0, "odd\nrole\\n<|", "t"),
    *[(5, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(300)],
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).repartition(3)
    made = chat.format_conversations(turns)
    back = {r["conv_id"]: r for r in chat.parse_conversations(made, keep=("segments", "valid", "n_turns")).withColumn("loss", chat.loss_text(F.col("segments"))).collect()}
    by = {}
    for c, n, role, text in TURNS:
        by.setdefault(c, []).append(((n is not None, n), role or "", text or ""))
    assert set(back) == set(by)
    for c, said in by.items():
        said = sorted(said, key=lambda s: (s[0][0], s[0][1] or 0, s[1], s[2]))
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [(r, x) for _, r, x in said]
        assert back[c]["loss"] == "".join(x for _, r, x in said if r == "assistant")
        assert "".join(s["text"] for s in back[c]["segments"]) == back[c]["formatted"]
        assert back[c]["formatted"].count("<|im_start|>") == back[c]["n_turns"] == len(said)
    assert {c: r["valid"] for c, r in back.items()} == {1: True, 2: False, 3: False, None: True, 4: False, 5: True}


def test_chat_of_nothing(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- duplicates -----------------------------------------------------------------------


def test_exact_groups(messy, nothing):
    got = exact.exact_groups(messy)
    assert rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(brute.exact(ROWS), key=repr)
    assert exact.exact_groups(nothing).count() == 0
    carried = exact.exact_groups(messy, carry=True).where("kept").select("row.*")
    assert carried.columns == messy.columns
    assert carried.count() == len({r[4] for r in brute.exact(ROWS)})


def test_a_hot_group_spans_partitions(spark):
    docs = [(i, "same  text " if i % 3 else f"own {i}") for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows(exact.exact_groups(frame), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(brute.exact(docs), key=repr)


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (2, 60)])
def test_components(messy, k, percent, sizes):
    got = jaccard.components(messy, shingle=k, percent=percent)
    want = brute.components(ROWS, k, percent)
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


def test_chains_and_mixed_buckets(spark):
    import random

    rng = random.Random(5)
    docs, base = [], [f"w{k}" for k in range(60)]
    for i in range(150):  # drifts, so that only neighbours link
        base[rng.randrange(60)] = f"v{i}"
        docs.append((i, " ".join(base)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for percent in (80, 90):
        assert rows(jaccard.components(frame, 1, percent), "doc_id", "n_shingles", "component_id") == sorted(brute.components(docs, 1, percent), key=repr)


def test_components_of_nothing(nothing):
    assert jaccard.components(nothing).count() == 0


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(1)
    for n in (3, 7, 12, 40, 300):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            b = a.copy()
            drop = rng.integers(0, max(1, n * 15 // 200) + 1)
            b = np.unique(np.concatenate([b[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both) and both < len(a):
                keys, which = jaccard.part_keys([a, b], 85)
                assert np.intersect1d(keys[which == 0], keys[which == 1]).size


@pytest.mark.parametrize("window", [35, 5])
def test_repeats(messy, window, sizes):
    got = substrings.remove_repeats(messy, window=window, automaton_chars=3000)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept") == brute.repeats(ROWS, window)


def test_repeats_of_nothing(nothing):
    assert substrings.remove_repeats(nothing).count() == 0
