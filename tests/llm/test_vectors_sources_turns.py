"""Near vectors, divergence of sources and repair of conversations, against brute force over rows that try everything."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

import brute
from scriptorium.llm import divergence, lattice, repair

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# near vectors


def near_rows(seed=3, d=20):
    """(id, vector, label): near copies at the threshold, exact and scaled copies, repeated and null ids, and vectors that link with nothing."""
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for g in range(12):
        centre = rng.normal(size=d)
        centre /= np.linalg.norm(centre)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((i, (centre + rng.normal(size=d) * 0.1 / np.sqrt(d) * rng.uniform(0.5, 2.5)).tolist(), g % 3))
            i += 1
    rows += [(i + k, rng.normal(size=d).tolist(), k % 3) for k in range(60)]
    copy = rows[5]
    rows += [(200 + k, copy[1], copy[2]) for k in range(5)] + [(210, [3 * x for x in copy[1]], copy[2]), (211, copy[1], (copy[2] + 1) % 3), (212, copy[1], None)]
    rows += [(200, rows[9][1], rows[9][2]), (None, rows[9][1], rows[9][2]), (None, [1e200 * x for x in rows[9][1]], rows[9][2]), (None, rng.normal(size=d).tolist(), 1)]
    rows += [(220, None, 1), (221, [], 1), (222, [0.0] * d, 1), (223, [float("nan")] + [1.0] * (d - 1), 1), (224, [float("inf")] + [1.0] * (d - 1), 1), (225, [None] + [1.0] * (d - 1), 1), (226, copy[1][: d - 1], copy[2]), (227, copy[1][: d - 1], copy[2])]
    return rows


def near_brute(rows, least=0.98):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    unit = [np.array(v) / np.abs(v).max() if g else None for g, (_, v, _) in zip(good, rows, strict=True)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    links = collections.defaultdict(set)
    for a, b in itertools.combinations([k for k, g in enumerate(good) if g], 2):
        if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least - 1e-12:
            links[a].add(b)
            links[b].add(a)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        first = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
        out.append((i, len(links[k]), first, first == i))
    return sorted(out, key=repr)


@pytest.mark.parametrize("few", [1024, 3])
def test_near_vectors(spark, monkeypatch, few):
    monkeypatch.setattr(lattice, "SLICE", few)
    monkeypatch.setattr(lattice, "FEW", few)
    rows = near_rows()
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, node string, component string").repartition(3)
    got = lattice.near_vectors(frame)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = near_brute(rows)
    assert sum(r[1] for r in want) > 150
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_near_vectors_of_nothing(spark):
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_neighbours_reach_every_cell():
    """Points as near as can be in some table share a cell there."""
    rng = np.random.default_rng(1)
    assert len(lattice.neighbours()) == 2401
    for d in (3, 16, 64):
        one = lattice.units(rng.normal(size=(300, d)))
        off = rng.normal(size=(300, d))
        off -= (off * one).sum(1)[:, None] * one
        two = lattice.units(one + off / np.linalg.norm(off, axis=1)[:, None] * np.tan(np.arccos(0.98)))
        group = np.zeros(300, np.uint64)
        met = np.zeros(300, bool)
        for (row, key, drawn), (other, mine, seen) in zip(lattice.table_rows(group, one, 0.98, 2.1), lattice.table_rows(group, two, 0.98, 2.1), strict=True):
            left, right = collections.defaultdict(set), collections.defaultdict(set)
            for r, k in zip(row.tolist(), key.tolist(), strict=True):
                left[r].add(k)
            for r, k in zip(other.tolist(), mine.tolist(), strict=True):
                right[r].add(k)
            a, b = (np.zeros((300, 2), np.int64) for _ in range(2))
            a[row], b[other] = drawn, seen
            near = ((a.view(np.int8).astype(float) - b.view(np.int8)) ** 2).sum(1) <= lattice.sketch_bound(0.98)
            assert near.all()
            met |= np.array([bool(left[r] & right[r]) for r in range(300)])
        assert met.all()


# divergence


def divergence_brute(docs, top=200):
    lower = [(lang or "", source or "", TERM.findall((text or "").translate(brute.LOW))) for lang, source, text in docs]
    docs_with, total, group = collections.Counter(), collections.Counter(), collections.defaultdict(collections.Counter)
    for lang, source, words in lower:
        docs_with.update({(lang, w) for w in words})
        total.update((lang, w) for w in words)
        group[lang, source].update(words)
    kept = collections.defaultdict(list)
    for (lang, w), n in docs_with.items():
        if n >= 3:
            kept[lang].append(w)

    def share(counts, words):
        whole = sum(counts[w] for w in words) + len(words)
        return {w: 1 + 10**9 * (counts[w] + 1) // whole for w in words}

    out = []
    for (lang, source), counts in group.items():
        p = share(counts, kept[lang])
        pairs = []
        for other_lang, other in group:
            if other_lang == lang and other != source:
                q = share(group[lang, other], kept[lang])
                pairs.append((-sum((p[w] - q[w]) ** 2 // q[w] for w in p), other.encode(), other))
        q = share(collections.Counter({w: total[lang, w] for w in kept[lang]}), kept[lang])
        terms = [(-((p[w] - q[w]) ** 2 // q[w]), w.encode(), w) for w in p if counts[w] and p[w] > q[w]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item, -value, k + 1) for k, (value, _, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("chunk", "block"), [(1 << 13, 8), (7, 2)])
def test_divergence(spark, chunk, block):
    rng = random.Random(5)
    words = ["the", "The", "été", "Ärger", "日本", "b1c", "x-y", "don't", "zz"] + [a + b for a in "abcd" for b in "efghij"]
    docs = [(rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", "ß", None]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(150)]
    docs += [("en", "s0", None), ("en", "empty", "1 2 3"), ("xx", "a", "only here"), ("xx", "b", "here"), ("xx", "c", ""), ("en", "long", "the a!" * 400_000), ("en", "s1", docs[0][2]), ("en", "s1", docs[0][2])]
    frame = spark.createDataFrame([(k % 7 or None, t, lang, s, "1", "2") for k, (lang, s, t) in enumerate(docs)], "doc_id long, text string, lang string, source string, term string, n string").repartition(4)
    got = divergence.divergence(frame, chunk_terms=chunk, block_groups=block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = divergence_brute(docs)
    assert {r[0] for r in want} == {"", "de", "en", "xx"}
    assert sorted(tuple(r) for r in got.collect()) == want


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []


def test_every_two_blocks_meet_once():
    for n in range(1, 12):
        met = collections.Counter(tuple(sorted((b, o))) for b in range(n) for o in divergence.opponents(b, n))
        assert met == collections.Counter(itertools.combinations(range(n), 2))


def test_shares_are_exact():
    rng = random.Random(2)
    for _ in range(200):
        n = [rng.randint(0, 2**40) for _ in range(5)]
        total = sum(n) + rng.randint(1, 10**6)
        assert divergence.shares(np.array(n), total).tolist() == [1 + 10**9 * (c + 1) // total for c in n]


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE_BYTES", 5)
    text = "Hello wörld, Überlänge  a b1c"
    assert [w.decode() for piece in divergence.terms_of(text.encode()) for w in piece] == TERM.findall(text.translate(brute.LOW))


# repair


def damaged_brute(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = brute.zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def repair_brute(rows):
    """gaps, counts, and the cheapest edits of one conversation's sorted rows, with everything a way has done carried along."""
    seen, kinds = set(), []
    for _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        kinds.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    after = {"": "us", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def least(ways):
        out = {}
        for cost, edits, last, turns in ways:
            if last not in out or (cost, edits) < out[last][:2]:
                out[last] = (cost, edits, last, turns)
        return list(out.values())

    def inserted(ways):
        for _ in range(4):
            ways = least(ways + [(c + 3, e + "I", x, (t, name[x] + ":")) for c, e, last, t in ways for x in after[last] if x in name])
        return ways

    ways = inserted([(0, "", "", None)])
    for (_, role, text), kind in zip(rows, kinds, strict=True):
        new = [(c + 4, e + "D", last, t) for c, e, last, t in ways]
        if kind in ("", "truncated"):
            more = 3 if kind else 0
            new += [(c + more, e + "K", role[:1], (t, f"{role}:{text}")) for c, e, last, t in ways if role and role[0] in after[last]]
            new += [(c + more + 3, e + "R", x, (t, f"{name[x]}:{text}")) for c, e, last, t in ways for x in after[last] if x in name]
        ways = inserted(least(new))
    cost, edits, _, chain = min(w[:3] + (w[3],) for w in ways if w[2] in ("", "a"))
    turns = []
    while chain:
        chain, turn = chain
        turns.append(turn)
    known = [t for t, _, _ in rows if t is not None]
    counts = collections.Counter(kinds)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(turns[::-1]).encode()).hexdigest()


def talk_rows():
    rng = random.Random(11)
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv or None, rng.choice([turn, turn, turn, turn + 2, None]), role, rng.choice(["Yes.", "No!", "Why?", "cut", "", " \n", None, "Ok. ", "é…", "x" * 3000 + "."])))
    rows += [(900, t, "user" if t % 2 == 0 else "assistant", f"Line {t}.") for t in range(700)]
    rows += [(901, t, rng.choice(["user", "assistant"]), f"Line {t}" + rng.choice([".", ""])) for t in range(700)]
    return rows


def conversations(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn, role, text))
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def test_repair(spark):
    rows = talk_rows()
    frame = spark.createDataFrame([(*r, "x", None) for r in rows], "conv_id long, turn long, role string, text string, cost string, audit string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in repair.repair_conversations(repair.damage(frame), here_col="here").collect()}
    own = conversations(damaged_brute(rows))
    assert got == {conv: repair_brute(own.get(conv, [])) for conv in {r[0] for r in rows}}
    steps = repair.repaired_turns(repair.damage(frame), here_col="here").orderBy("conv_id", "place").collect()
    turns, edits = collections.defaultdict(list), collections.defaultdict(str)
    for conv, _, edit, role, text in steps:
        edits[conv] += edit
        if role is not None:
            turns[conv].append(f"{role}:{text}")
    for conv, result in got.items():
        assert edits[conv] == result[6]
        assert hashlib.sha256("\n".join(turns[conv]).encode()).hexdigest() == result[7]
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in turns[conv]))


def test_repair_against_every_string_of_edits():
    """The least of all strings of edits of short conversations, not of a layer's."""
    rng = random.Random(4)
    for _ in range(60):
        rows = [(k, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No.", "cut", ""])) for k in range(rng.randint(0, 3))]
        talk, seen, kinds = repair.Conversation(), set(), []
        for row in rows:
            list(talk.add(*row))
            kinds.append((not row[2], row[1:] in seen, row[2] == "cut"))
            seen.add(row[1:])
        list(talk.finish())
        found = []
        for size in range(len(rows), len(rows) + 5):
            for letters in itertools.product("DIKR", repeat=size):
                if sum(x != "I" for x in letters) != len(rows):
                    continue
                state, cost, used = "", 0, 0
                for x in letters:
                    if x == "I":
                        state, cost = repair.NEXT[state], cost + 3
                        continue
                    (blank, again, cut), role = kinds[used], rows[used][1]
                    used += 1
                    if x == "D":
                        cost += 4
                        continue
                    if blank or again or (x == "K" and not (role[0] == repair.NEXT[state] or (role[0] == "s" and not state))):
                        break
                    cost += 3 * cut + 3 * (x == "R")
                    state = role[0] if x == "K" else repair.NEXT[state]
                else:
                    if state in ("", "a"):
                        found.append((cost, "".join(letters)))
        assert min(found) == (talk.cost, "".join(talk.audit))


def test_a_long_conversation_is_settled_as_it_goes():
    talk = repair.Conversation()
    for k in range(5000):
        list(talk.add(k, "user" if k % 2 == 0 else "assistant", f"{k}."))
        assert len(talk.rows) <= 2 * repair.SETTLE
    list(talk.finish())
    assert talk.summary()[5] == 0


def test_repair_of_nothing(spark):
    assert repair.repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
