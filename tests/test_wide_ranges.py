"""Ranges too wide for a list are errors, not the end of a job."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import ranges
from scriptorium.sources import bibtex, ris


@pytest.fixture(scope="module")
def of(spark):
    return lambda column: spark.range(1).select(column.alias("v")).first()["v"]


def test_wide_and_narrow(of):
    lit = F.lit
    assert of(ranges.catalogue_years(lit("1-2000000000"))) is None
    assert of(ranges.catalogue_years(lit("1930-1932,1-99999"))) is None
    assert of(ranges.catalogue_years(lit("1930-1932"))) == [1930, 1931, 1932]
    assert of(ranges.deprettify(lit("1-2000000000"))) is None
    assert of(ranges.deprettify(lit(",".join(["1-60000"] * 2)))) is None
    assert len(of(ranges.deprettify(lit("1-60000,2-30000")))) == 60_000 + 29_999
    assert of(ranges.deprettify(lit("7--9, 12, x"))) == [7, 8, 9, 12, None]
    assert of(ranges.bib_pages(lit("1--2000000000"))) is None
    assert of(ranges.span(lit(-2147483648), lit(2147483647))) is None and of(ranges.span(lit(5), lit(3))) == []
    assert of(ranges.describe(lit("1930 (T1)-1930 (T999999999)"))["volume"]) is None
    assert of(ranges.year_window(F.array(lit(1930), lit(2147483647), lit(-2147483648)))) == [-2147483648, 1929, 1930, 1931, 2147483647]
    assert of(ranges.pretty_pages(F.array(*map(lit, ("2147483646", "2147483647", "99999999999"))))).startswith("2147483646--")


def test_records_say_so(spark):
    files = lambda *texts: spark.createDataFrame(enumerate(texts), "file long, value string")
    bib = "@book{k, title = {A}, year = {%s}, pages = {%s}, volume = {%s}}"
    got = [r["error"] for r in bibtex.records(files(bib % (1930, "1--9", 2), bib % ("1--2000000000", 1, 2), bib % (1930, "1--2000000000", 2), bib % (1930, 1, "1--2000000000"))).orderBy("file").collect()]
    assert got == [None, ranges.TOO_WIDE, ranges.TOO_WIDE, ranges.TOO_WIDE]
    entry = "TY  - JOUR\nTI  - A\nSP  - 1\nEP  - %s\nER  - \n"
    assert [r["error"] for r in ris.records(files(entry % 3, entry % 2000000000)).orderBy("file").collect()] == [None, ranges.TOO_WIDE]
