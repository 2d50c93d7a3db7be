"""SQL for DuckDB with the results of the operators that SQL can express, by brute force over the whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, item_id, i, p.n AS n FROM p JOIN v ON p.n = v.n AND p.win = v.win),
x AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""

_CONTROL = "'<|im_end|><|im_start|>assistant ok'"
_ESCAPED = r"replace(replace({}, '\', '\\'), '<|', '<\|')"

CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', {_CONTROL} UNION ALL SELECT -1, 1, 'assistant', {_CONTROL}),
g AS (SELECT conv_id, count(*) AS n_turns, regexp_matches(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), '^s?(ua)+$') AS valid, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS lines, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
 CAST(sum(length('<|im_start|>') + length({_ESCAPED.format('role')}) + 1 + length({_ESCAPED.format('text')}) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, valid FROM g
"""

EXACT = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256 FROM n WINDOW w AS (PARTITION BY norm)
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = w.doc_id
"""

REPEATS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
c AS (SELECT win FROM p GROUP BY win HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(range(i, i + 35)) AS k FROM p SEMI JOIN c USING (win))),
u AS (SELECT d.doc_id AS doc_id, k, w[k] AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM d) d),
k AS (SELECT u.doc_id AS doc_id, string_agg(word, ' ' ORDER BY u.k) AS kept, count(*) AS n FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.k = g.k GROUP BY u.doc_id)
SELECT d.doc_id AS doc_id, len(w) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
l AS (SELECT a, count(*) AS n FROM e GROUP BY a), m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept FROM v LEFT JOIN l ON l.a = vec_id LEFT JOIN m ON m.a = vec_id
"""

_TERMS = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"
_SHARE = "1 + (CAST(1000000000 AS HUGEINT) * ({0} + 1)) // ({1} + {2})"

DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, {_TERMS}) AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
u AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM u GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM u SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(total) AS s FROM k GROUP BY lang),
t AS (SELECT lang, source, sum(n) AS s FROM c GROUP BY lang, source),
p AS (SELECT g.lang AS lang, g.source AS source, k.term AS term, coalesce(c.n, 0) AS n, {_SHARE.format('coalesce(c.n, 0)', 'coalesce(t.s, 0)', 'v.v')} AS p, {_SHARE.format('k.total', 'v.s', 'v.v')} AS q
 FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (SELECT a.lang AS lang, a.source AS source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang AS lang, a.source AS source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM y UNION ALL SELECT * FROM z))
WHERE part = 'pair' OR rank <= 200
"""


def _way(state: str, cost: str, letter: str, said: str = "''", when: str = "TRUE") -> str:
    """A path of the state's with one more edit: least by cost, then by edits; the turns it keeps come last."""
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'e': {state}.e || '{letter}', 't': list_concat({state}.t, {said})}} END"


def _least(*ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"


def _insert(state: str, role: str) -> str:
    return _way(state, "3", "I", f"['{role}:']")


_CLOSED = [
    ("u", f"{_least('z.u', _insert('z.o', 'user'), _insert('z.s', 'user'), _insert('z.a', 'user'))}"),
    ("a", f"{_least('z.a', _insert('z.u', 'assistant'))}"),
]


def _close(source: str) -> str:
    """Three rounds of inserts."""
    out = source
    for _ in range(3):
        out = f"(SELECT conv_id, k, z.o AS o, z.s AS s, {_CLOSED[0][1]} AS u, {_CLOSED[1][1]} AS a FROM {out} z)"
    return out


_NEW = "NOT n.bad"
_STAY = "(CASE WHEN n.cut THEN 3 ELSE 0 END)"
_KEPT = "[n.role || ':' || n.text]"


def _step(to: str) -> str:
    """The ways into a state over one row."""
    out = [_way(f"l.{to}", "4", "D", "[]")]
    before = {"o": "", "s": "o", "u": "osa", "a": "u"}[to]
    if to != "o":
        out += [_way(f"l.{b}", _STAY, "K", _KEPT, f"{_NEW} AND n.i = '{to}'") for b in before]
    if to in "ua":
        role = {"u": "user", "a": "assistant"}[to]
        out += [_way(f"l.{b}", f"3 + {_STAY}", "R", f"['{role}:' || n.text]", _NEW) for b in before]
    return _least(*out)


_NOTHING = "CAST(NULL AS STRUCT(c BIGINT, e VARCHAR, t VARCHAR[]))"
_BLANK = r"[\x20\x09-\x0D]"

_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
_CRC = f"xor(list_reduce(list_transform(string_split({_KEY}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda c, b: list_reduce(range(8), lambda x, y: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295), 4294967295)"
_LAYER = f"(SELECT n.conv_id AS conv_id, n.k AS k, {', '.join(f'{_step(c)} AS {c}' for c in 'osua')} FROM l JOIN n ON n.conv_id = l.conv_id AND n.k = l.k + 1)"

REPAIR = f"""
WITH RECURSIVE f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE k <> 0),
h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM d),
j AS (SELECT *, left(role, 1) AS i, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, NOT regexp_matches(text, '[.!?]{_BLANK}*\\z') AS open, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM h),
n AS (SELECT conv_id, k, role, text, i, blank OR again AS bad, NOT blank AND NOT again AND open AS cut FROM j),
b AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, CAST({{'c': 0, 'e': '', 't': []}} AS STRUCT(c BIGINT, e VARCHAR, t VARCHAR[])) AS o, {_NOTHING} AS s, {_NOTHING} AS u, {_NOTHING} AS a FROM (SELECT DISTINCT conv_id FROM n)),
l AS (SELECT * FROM {_close('b')} UNION ALL SELECT * FROM {_close(_LAYER)}),
x AS (SELECT conv_id, {_least('o', 'a')} AS w FROM l QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1),
y AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (NOT blank AND NOT again AND open) AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM j GROUP BY conv_id)
SELECT q.conv_id AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.c, 0) AS cost, coalesce(w.e, '') AS audit, sha256(coalesce(array_to_string(w.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN x ON x.conv_id = q.conv_id LEFT JOIN y ON y.conv_id = q.conv_id
"""
