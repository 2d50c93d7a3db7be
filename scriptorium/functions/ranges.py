"""Page, volume and year ranges.

A range, or a list of them, of more than MOST members is no range but a mistake, and a null;
what reads records says so as an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]
_NO_INTS = "array<int>"
#: Members that a list of ranges has at most.
MOST = 100_000
TOO_WIDE = "range too wide"


def span(a: Column, b: Column) -> Column:
    """a..b inclusive; empty if b < a (sequence alone would count down), null if too wide."""
    return F.when(_size(a, b) > MOST, F.lit(None)).when(b >= a, F.sequence(a, b)).otherwise(F.array().cast(_NO_INTS))


def _size(a: Column, b: Column) -> Column:
    return b.cast("bigint") - a.cast("bigint") + 1


def to_roman(n: Column) -> Column:
    """Lower-case roman numeral of 1 to 4999."""
    unit = lambda signs, d: F.element_at(F.array(*map(F.lit, signs)), d.cast("int") + 1)
    rows = [[""] + ["m" * k for k in range(1, 5)]]
    rows += [["", a, a * 2, a * 3, a + b, b, b + a, b + a * 2, b + a * 3, a + c] for a, b, c in ("cdm", "xlc", "ivx")]
    digits = [F.floor(n / 1000), F.floor(n / 100) % 10, F.floor(n / 10) % 10, n % 10]
    return F.concat(*[unit(r, d) for r, d in zip(rows, digits, strict=True)])


def from_roman(text: Column) -> Column:
    """Value of a roman numeral of either case; null if it is none in canonical form."""
    signs = {"m": 1000, "d": 500, "c": 100, "l": 50, "x": 10, "v": 5, "i": 1}
    low = F.lower(text)
    value = lambda c: reduce(lambda out, s: F.when(c == s[0], F.lit(s[1])).otherwise(out), signs.items(), F.lit(0))
    at = lambda i: value(F.substring(low, i, F.lit(1)))
    total = F.aggregate(F.sequence(F.lit(1), F.length(low)), F.lit(0), lambda a, i: a + F.when(at(i) < at(i + 1), -at(i)).otherwise(at(i)))
    good = low.rlike(r"^(?=.)m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
    return F.when(good, total)


def prettify(start: Column, end: Column, roman: Column) -> Column:
    """'start--end'; of an end as long as the start, the digits equal in place are left out."""
    s = F.when(roman, to_roman(start)).otherwise(start.cast("string"))
    e = F.when(roman, to_roman(end)).otherwise(end.cast("string"))
    kept = F.array_join(F.transform(F.sequence(F.lit(1), F.length(e)), lambda i: F.when(F.substring(e, i, F.lit(1)) != F.substring(s, i, F.lit(1)), F.substring(e, i, F.lit(1))).otherwise("")), "")
    return F.concat(s, F.lit("--"), F.when((F.length(s) == F.length(e)) & ~roman, kept).otherwise(e))


def pretty_pages(pages: Column) -> Column:
    """Runs of consecutive pages (an array of strings, arabic or roman) as ranges, joined by ', '."""
    parsed = F.transform(pages, lambda p: F.struct(p.rlike("^[0-9]+$").alias("arabic"), F.when(p.rlike("^[0-9]+$"), p.try_cast("int")).otherwise(from_roman(p)).alias("n")))

    def grow(runs: Column, p: Column) -> Column:
        last = F.element_at(runs, -1)
        joins = (F.size(runs) > 0) & (last["arabic"] == p["arabic"]) & (last["b"].cast("bigint") + 1 == p["n"])
        one = lambda a: F.array(F.struct(p["arabic"].alias("arabic"), a.alias("a"), p["n"].alias("b")))
        return F.when(joins, F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), one(last["a"]))).otherwise(F.concat(runs, one(p["n"])))

    runs = F.aggregate(parsed, F.array().cast("array<struct<arabic:boolean,a:int,b:int>>"), grow)
    return F.array_join(F.transform(runs, lambda r: prettify(r["a"], r["b"], ~r["arabic"])), ", ")


def deprettify(text: Column) -> Column:
    """Integers of a list of ranges such as '450--5, 460'; a shorter end takes the start's first digits."""

    def one(part: Column) -> Column:
        ends = F.split(F.trim(part), "-+")
        s, e = F.trim(F.get(ends, F.lit(0))), F.trim(F.get(ends, F.lit(1)))
        full = F.when(F.length(e) < F.length(s), F.concat(F.substring(s, F.lit(1), F.length(s) - F.length(e)), e)).otherwise(e)
        return F.struct(s.try_cast("int").alias("a"), full.try_cast("int").alias("b"), e.isNull().alias("single"))

    parts = F.transform(F.split(text, ","), one)
    # counted before any is made
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, p: n + F.when(p["single"], 1).otherwise(F.greatest(F.lit(0), F.coalesce(_size(p["a"], p["b"]), F.lit(0)))))
    alone = text.rlike("^[0-9]{1,9}$")  # most are
    return F.when(alone, F.array(text.try_cast("int"))).when(total <= MOST, F.flatten(F.transform(parts, lambda p: F.when(p["single"], F.array(p["a"])).otherwise(span(p["a"], p["b"])))))


def bib_pages(text: Column) -> Column:
    """Pages of a BibTeX field, as strings: 'a-b' or 'a--b', roman if it holds an i, else the field alone.

    An arabic end below its start takes the start's first digit, as records of
    the kind '547--51' need.
    """
    parts = F.split(F.replace(text, F.lit("--"), F.lit("-")), "-")
    roman, lower = F.lower(text).contains("i"), text.contains("i")
    s, e = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    a = F.when(roman, from_roman(s)).otherwise(s.try_cast("int"))
    plain = F.when(roman, from_roman(e)).otherwise(e.try_cast("int"))
    b = F.when(~roman & (plain < a), F.concat(F.substring(s, 1, 1), e).try_cast("int")).otherwise(plain)
    show = lambda n: F.when(roman & lower, to_roman(n)).when(roman, F.upper(to_roman(n))).otherwise(n.cast("string"))
    good = (F.size(parts) == 2) & a.isNotNull() & b.isNotNull()
    return F.when(good, F.transform(span(a, b), show)).otherwise(F.array(text))


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("int")


def describe(text: Column) -> dict[str, Column]:
    """year, volume and number of an issue's description, each an array (null if absent) of a range's integers, and whether it is a list."""
    halves = F.split(text, "-")
    out = {}
    for field, pattern in (("year", "([0-9]{4})"), ("volume", "T([0-9]+)"), ("number", "N([0-9]+)")):
        a, b = _found(F.get(halves, F.lit(0)), pattern), _found(F.get(halves, F.lit(1)), pattern)
        is_range = a.isNotNull() & b.isNotNull() & (a != b)
        out[field] = F.when(is_range, span(a, b)).when(a.isNotNull(), F.array(a))
        out[f"{field}_is_list"] = F.coalesce(is_range, F.lit(False))
    return out


def catalogue_years(text: Column) -> Column:
    """Years of a catalogue's date: a list of years and ranges; a half-open range stands alone, replacing what came before."""

    def ends_of(part: Column) -> Column:
        """A part's ends, read once."""
        ends = F.split(part, "-")
        return F.struct(F.size(ends).alias("n"), F.trim(F.get(ends, F.lit(0))).try_cast("int").alias("a"), F.trim(F.get(ends, F.lit(1))).try_cast("int").alias("b"))

    def step(state: Column, part: Column) -> Column:
        n, a, b = part["n"], part["a"], part["b"]
        wide = F.coalesce(F.size(state["years"]) + _size(a, b) > MOST, F.lit(False))
        bad = (n > 2) | (a.isNull() & b.isNull()) | wide
        whole = F.when(n == 1, F.concat(state["years"], F.array(a))).when(a.isNotNull() & b.isNotNull(), F.concat(state["years"], span(a, b))).otherwise(F.array(F.coalesce(a, b)))
        return F.struct(F.when(bad, state["years"]).otherwise(whole).alias("years"), (state["bad"] | bad).alias("bad"))

    end = F.aggregate(F.transform(F.split(text, ","), ends_of), F.struct(F.array().cast(_NO_INTS).alias("years"), F.lit(False).alias("bad")), step)
    return F.when(~end["bad"], end["years"])


def year_window(years: Column) -> Column:
    """The years from one before to one after each, distinct, ascending; a year of more than six digits stands alone."""
    near = lambda y: F.when(y.between(-1_000_000, 1_000_000), F.sequence(y - 1, y + 1)).otherwise(F.array(y))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(years, near))))
