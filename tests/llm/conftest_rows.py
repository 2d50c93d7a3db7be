"""Rows that try everything."""

import random


SYLLABLES = "an ba co dé eü fi go hu ïn jo ka lo mé nu os pi qu ra sé to".split()


def prose(rng, n, vocabulary=400):
    made = random.Random(1)
    known = ["".join(made.choices(SYLLABLES, k=made.randint(1, 4))) for _ in range(vocabulary)]
    known[0], known[1], known[2] = "The", "don't", "x,"
    return " ".join(rng.choices(known, weights=[1 / (k + 2) for k in range(vocabulary)], k=n))


def messy_rows():
    """(doc_id, text): nulls, blanks, copies, near copies, shared passages, signs, a long text, repeated rows, rows without an id."""
    rng = random.Random(7)
    passage, base = prose(rng, 60), prose(rng, 150)
    rows = [(i, prose(rng, rng.randint(1, 200))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, " \t\n "), (43, "one"), (44, "one"), (45, "A  b\nc"), (46, "A b c"), (47, "a b c")]
    rows += [(50 + i, base.replace("the ", "an ", i)) for i in range(6)]
    near = base.split()
    rows += [(60 + i, " ".join(near[: 3 * i] + ["zz"] + near[3 * i + 1 :])) for i in range(12)]
    rows += [(80 + i, prose(rng, 30) + "\n" + passage + " \x0b" + prose(rng, 5)) for i in range(4)]
    rows += [(90, passage + " " + passage), (91, "ha " * 100), (92, "日本語 テスト\u3000x\u00a0y é 👍🏽 '' '' 's don't we'll 12345 \x00\x01"), (93, "y" * 3000 + " " + "ab" * 700)]
    rows += [(94, prose(rng, 30_000)), (95, prose(rng, 20)), (95, prose(rng, 20)), (96, base), (96, base)]
    rows += [(None, prose(rng, 40)), (None, " ".join(["zz", *near[1:]])), (None, passage), (None, None), (None, None)]
    return rows
