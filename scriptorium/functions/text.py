"""String functions: normal form, similarity, names, slugs, keys."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import bits

ASCII = r"^[\x00-\x7F]*$"
_ENDS = r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


@F.pandas_udf(T.StringType())
def _nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKD", s).lower().strip(), na_action="ignore")


def plain(text: Column) -> Column:
    """NFKD, lower case, stripped; null for null or ''. Only texts beyond ASCII leave the JVM."""
    ascii_only = text.rlike(ASCII)
    return F.when(F.length(text) > 0, F.when(ascii_only, F.regexp_replace(F.lower(text), _ENDS, "")).otherwise(_nfkd(F.when(~ascii_only, text))))


def indel_ratio(a: str | None, b: str | None) -> int:
    """100 * 2 * LCS / (len a + len b), half to even; 0 if either is empty or null. Bit-parallel."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        met = rows & masks.get(c, 0)
        rows = ((rows + met) | (rows - met)) & full
    return round(200 * (len(a) - rows.bit_count()) / (len(a) + len(b)))


def _distinct(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, list[tuple[str, str]]]:
    """The pair of each row among the distinct ones; nulls as ''."""
    pairs = list(zip(a.fillna(""), b.fillna(""), strict=True))
    known = dict(zip(dict.fromkeys(pairs), range(len(pairs)), strict=False))
    return np.array([known[p] for p in pairs], np.int64), list(known)


@F.pandas_udf(T.IntegerType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two strings from 0 to 100; equal pairs of a batch are compared once, short ones all at a time."""
    which, pairs = _distinct(a, b)
    out = np.zeros(len(pairs), np.int32)
    short = [k for k, (x, y) in enumerate(pairs) if x and y and min(len(x), len(y)) <= 64]
    common = bits.common_lengths([pairs[k] for k in short]) if short else []
    for k, n in zip(short, common, strict=True):
        out[k] = round(200 * int(n) / (len(pairs[k][0]) + len(pairs[k][1])))
    for k, (x, y) in enumerate(pairs):
        if min(len(x), len(y)) > 64:
            out[k] = indel_ratio(x, y)
    return pd.Series(out[which], dtype="int32")


@F.pandas_udf(T.IntegerType())
def ratio_bound(a: pd.Series, b: pd.Series) -> pd.Series:
    """What the similarity of two strings cannot exceed: a common subsequence has no more of a character than either string."""
    which, pairs = _distinct(a, b)
    if not pairs:
        return pd.Series([], dtype="int32")
    most = np.minimum(bits.bags([x for x, _ in pairs]), bits.bags([y for _, y in pairs])).sum(1)
    out = np.array([round(200 * int(n) / (len(x) + len(y))) if x and y else 0 for n, (x, y) in zip(most, pairs, strict=True)], np.int32)
    return pd.Series(out[which], dtype="int32")


def ratio_native(a: Column, b: Column) -> Column:
    """The same by higher-order functions only, for names of some thirty characters."""
    chars = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))

    def row(above: Column, x: Column) -> Column:
        step = lambda left, j: F.concat(
            left, F.array(F.when(x == F.substring(b, j, F.lit(1)), F.element_at(above, j) + 1).otherwise(F.greatest(F.element_at(above, j + 1), F.element_at(left, j))))
        )
        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), step)

    lcs = F.element_at(F.aggregate(chars(a), F.array_repeat(F.lit(0), F.length(b) + 1), row), -1)
    empty = (F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0)
    return F.when(empty, F.lit(0)).otherwise(F.bround(lcs * 200 / (F.length(a) + F.length(b))).cast("int"))


def confidence(score: Column) -> Column:
    """A score as per cent in four significant digits, '.0' kept."""
    value = score * 100
    digits = F.when(value >= 100, 1).when(value >= 10, 2).when(value >= 1, 3).otherwise(4)
    shown = F.when(digits == 1, F.round(value, 1)).when(digits == 2, F.round(value, 2)).when(digits == 3, F.round(value, 3)).otherwise(F.round(value, 4))
    return F.concat(shown.cast("string"), F.lit(" %"))


def name(title: Column, author: Column, short: int | None = None) -> Column:
    """'title (author)', either cut to `short` characters if given."""
    cut = (lambda c: F.substring(c, 1, short)) if short is not None else (lambda c: c)
    return F.concat(cut(title), F.lit(" ("), cut(author), F.lit(")"))


def journal_name(title: Column, years: Column, volume: Column, number: Column, short: int | None = None) -> Column:
    """Journal title and years (as printed), with volume and number where they are not 0 or null."""
    head = F.substring(title, 1, short) if short is not None else title
    part = lambda c, word: F.when(F.coalesce(c, F.lit(0)) != 0, F.concat(F.lit(word), c.cast("string"))).otherwise("")
    return F.concat(head, F.lit(" "), years, part(volume, " vol. "), part(number, " n. "))


# fixed values: letters and their ASCII stand-ins
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāăąćčďēėęěğīįłńňőřśšťūůűźżž"
_PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyaaaccdeeeegiilnnorsstuuuzzz"
_PAIRS = {"æ": "ae", "œ": "oe", "ß": "ss"}


def slug(text: Column) -> Column:
    """Lower-case ASCII words joined by '-', which stands for apostrophes, too."""
    out = F.lower(text)
    for letter, two in _PAIRS.items():
        out = F.replace(out, F.lit(letter), F.lit(two))
    out = F.regexp_replace(F.translate(out, _ACCENTED, _PLAIN), "['’]", "-")
    return F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def python_repr(text: Column) -> Column:
    """A string as Python writes it: single quotes, or double ones around a single quote alone."""
    body = F.replace(F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    single, double = text.contains("'"), text.contains('"')
    quoted = F.when(single & ~double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.coalesce(quoted, F.lit("None"))


def int_repr(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def one_or_list_repr(values: Column, is_list: Column) -> Column:
    """An integer, or a list of them, as Python writes it."""
    return F.when(values.isNull(), "None").when(is_list, F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ", "), F.lit("]"))).otherwise(values[0].cast("string"))


def article_repr(c: dict[str, Column]) -> Column:
    """The canonical text of an article, of which its key is the SHA-1."""
    none = F.lit(None).cast("string")
    strings = lambda k: python_repr(c.get(k, none))
    many = lambda k: one_or_list_repr(c[k], c.get(f"{k}_is_list", F.lit(False))) if k in c else F.lit("None")
    pages = F.concat(F.lit("["), F.array_join(F.transform(c["pages"], python_repr), ", "), F.lit("]"))
    physical = F.coalesce(F.concat(F.lit("["), F.array_join(c["physical_pages"].cast("array<string>"), ", "), F.lit("]")), F.lit("None")) if "physical_pages" in c else F.lit("None")
    fields = {
        "publicationdate": many("publicationdate"), "publisher": strings("publisher"), "ark": strings("ark"), "title": strings("title"), "subtitle": strings("subtitle"), "journaltitle": strings("journaltitle"),
        "pages": pages, "author": strings("author"), "editor": strings("editor"), "number": many("number"), "volume": many("volume"), "physical_pages": physical,
    }
    return F.concat(F.lit("Article("), F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), v) for k, v in fields.items()]), F.lit(")"))


def key(canonical: Column) -> Column:
    """The identity of a record: SHA-1 of its canonical text."""
    return F.sha1(canonical)


def toc_entry(text: Column) -> tuple[Column, Column]:
    """(author, title) of a table of contents' line: 'author - title', else 'author. title', else no author."""
    dash, dot = r"(?d)^(.+?)\.* - (.+)", r"(?d)^(.+?)\. (.+)"
    # a line break ends what a dot matches, so the first line that fits counts
    find = lambda pattern, group: F.regexp_extract(text, pattern.replace("^", ""), group)
    author = F.when(text.rlike(dash.replace("^", "")), find(dash, 1)).when(text.rlike(dot.replace("^", "")), find(dot, 1)).otherwise("")
    title = F.when(text.rlike(dash.replace("^", "")), find(dash, 2)).when(text.rlike(dot.replace("^", "")), find(dot, 2)).otherwise(text)
    return F.trim(author), F.trim(title)


def first_of(values: Column) -> Column:
    """The first of a list; null for none or ''."""
    head = F.get(values, F.lit(0))
    return F.when(F.length(head) > 0, head)
