"""The operators' results, worked out row by row."""

import collections
import hashlib
import math
import re
import zlib

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def words(text, pattern=WORD, lower=False):
    text = text or ""
    return pattern.findall(text.translate(LOW) if lower else text)


def contamination(docs, bench, window=10):
    """docs and bench: lists of (id, text); per document (n_words, n_hit, items)."""
    windows = collections.defaultdict(set)
    for i, text in bench:
        w = tuple(words(text, ALNUM, True))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[w[k : k + window]].add(str(i))
    out = []
    for _, text in docs:
        w, hit, items = words(text, ALNUM, True), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        out.append((len(w), len(hit), sorted(items)))
    return out


def exact(docs):
    groups = collections.defaultdict(list)
    for i, text in docs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        ids.sort(key=null_first)
        for k, i in enumerate(ids):
            out.append((i, ids[0], len(ids), k == 0, sha(text)))
    return sorted(out, key=repr)


def null_first(i):
    return i is not None, i or 0


def shingles(text, k):
    w = words(text, WORD, True)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(docs, k, percent):
    sets = [shingles(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(docs):
        known = [x for x in (i, least.get(find(n))) if x is not None]
        least[find(n)] = min(known, default=None)
    return sorted(((i, len(sets[n]), least[find(n)] if sets[n] else i) for n, (i, _) in enumerate(docs)), key=repr)


def repeats(docs, window):
    count = collections.Counter()
    split = [words(t) for _, t in docs]
    for w in split:
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(docs, split, strict=True):
        gone = {k for a in range(len(w) - window + 1) if count[tuple(w[a : a + window])] > 1 for k in range(a, a + window)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def bigram_scores(docs, train, prior):
    """(n_tokens, n_known, train_tokens, base, score) of each document, without quantisation."""
    end = "\0"
    texts = [words(t, WORD, True) + [end] for _, t in docs]
    c, b = collections.Counter(), collections.Counter()
    for w, t in zip(texts, train, strict=True):
        if t:
            c.update(w)
            b.update(zip([end, *w], w, strict=False))
    n, v = sum(c.values()), len(c)
    base = lambda w: (c[w] + 1) / (n + v + 1)
    p = lambda a, w: b[a, w] / (c[a] + prior) + prior / (c[a] + prior) * base(w)
    return [(len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(base(x)) for x in w), sum(math.log10(p(a, x)) for a, x in zip([end, *w], w, strict=False))) for w in texts]


def crc(value, modulus):
    return zlib.crc32(str(value).encode()) % modulus
