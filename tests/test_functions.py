"""Functions of text, ranges and keys.

Fixed values: the SHA-1 of a canonical record, the key `pour-lir-m-d-ch`, and the
similarities 21, 60 and 53 of one pair of records are what any right result must be.
"""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import ark, fuzzy, ranges, text
from scriptorium.operators import imaging, matching, report


@pytest.fixture(scope="module")
def value(spark):
    """The value of a column."""
    return lambda *columns: (lambda row: row[0] if len(columns) == 1 else tuple(row))(spark.range(1).select(*columns).first())


lit = F.lit
none = None  # a null string, once there is a session


@pytest.fixture(scope="module", autouse=True)
def _null(spark):
    global none
    none = lit(None).cast("string")


def ints(*values):
    return F.array(*map(lit, values)) if values else F.array().cast("array<int>")


def strings(values):
    return F.array(*[lit(str(v)) for v in values])


def test_plain(value):
    got = value(*[text.plain(lit(s)) for s in ("asciitest", " É ", "")], text.plain(none))
    assert got == ("asciitest", "é", None, None)


def test_ratio(value):
    pairs = [("Pour lire saint Augustin", "CHENU"), ("La vie spirituelle", "La Vie spirituelle, ascétique et mystique"), ("M.-D. Chenu", "M.-D")]
    assert value(*[text.ratio(text.plain(lit(a)), text.plain(lit(b))) for a, b in pairs]) == (21, 60, 53)
    assert value(text.ratio(lit("a"), none), text.ratio(lit(""), lit("a"))) == (0, 0)


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
@settings(max_examples=100, deadline=None)
def test_indel_ratio_is_its_definition(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    assert text.indel_ratio(a, b) == (round(200 * rows[-1][-1] / (len(a) + len(b))) if a and b else 0)


def test_native_ratio(spark):
    pairs = [("kitten", "sitting"), ("a", "a"), ("abc", ""), ("blue bolt", "red bolt"), ("ab", "ba")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(text.ratio_native(F.col("a"), F.col("b")), text.ratio(F.col("a"), F.col("b"))).collect()
    assert all(r[0] == r[1] for r in rows)


GOLDEN = {"publicationdate": 1930, "title": 0.21, "journaltitle": 0.6, "pages": 1.0, "author": 0.53}


def golden_scores():
    pages = strings(range(135, 158))
    return {
        "publicationdate": matching.number_score(ints(1930), ints(1930)),
        "publisher": matching.text_score(none, lit("(Paris)")),
        "title": matching.text_score(lit("Pour lire saint Augustin"), lit("CHENU")),
        "journaltitle": matching.text_score(lit("La vie spirituelle"), lit("La Vie spirituelle, ascétique et mystique")),
        "pages": matching.number_score(pages, strings(range(135, 263)), lit(True), lit(True)),
        "author": matching.text_score(lit("M.-D. Chenu"), lit("M.-D")),
    }


def test_golden_score(value):
    scores = golden_scores()
    got = value(matching.mean_score(scores), matching.score_map(scores))
    assert got[0] == pytest.approx(0.668)
    assert got[1] == {k: pytest.approx(1.0 if k == "publicationdate" else v) for k, v in GOLDEN.items()}
    with_volume = scores | {"volume": matching.number_score(ints(24), ints(24))}
    assert value(text.confidence(matching.mean_score(with_volume))) == "72.33 %"


def test_number_scores(value):
    yes, no, nothing = lit(True), lit(False), lit(None).cast("array<int>")
    cases = [
        (matching.number_score(ints(1), nothing), 0.5), (matching.number_score(ints(1), ints(0)), 0.5), (matching.number_score(ints(1), ints(1)), 1), (matching.number_score(ints(1), ints(2)), 0),
        (matching.number_score(ints(1), ints(3, 1), no, yes), 1), (matching.number_score(ints(1), ints(3, 2), no, yes), 0), (matching.number_score(ints(1, 2, 2), ints(2, 3), yes, yes), 2 / 3),
        (matching.number_score(ints(1, 2), ints(2), yes, no), 0.5), (matching.number_score(ints(1, 2), ints(5), yes, no), 0), (matching.number_score(ints(1, 2), nothing, yes), 0),
        (matching.number_score(ints(), ints(1), yes, yes), None), (matching.number_score(nothing, ints(1)), None),
    ]
    assert value(*[c for c, _ in cases]) == tuple(pytest.approx(w) if w is not None else None for _, w in cases)
    journal = {"journaltitle": matching.text_score(lit("La vie spirituelle"), lit("La vie spirituelle, ascétique et mystique")), "year": matching.number_score(ints(1930), F.sequence(lit(1920), lit(1949)), no, yes)}
    assert value(matching.mean_score(journal)) == pytest.approx(0.8)


def test_keys(value):
    article = {
        "publicationdate": ints(1930), "title": lit("Pour lire saint Augustin"), "journaltitle": lit("La vie spirituelle"), "pages": strings(range(135, 158)), "author": lit("M.-D. Chenu"),
        "number": lit(None).cast("array<int>"), "volume": lit(None).cast("array<int>"),
    }
    assert value(text.key(text.article_repr(article))) == "ba07bc75d289254cfec1517a0fc9e59020d9a9af"
    for s in ("it's", 'a "q"', "it's \"q\"", "back\\slash", "line\nend\t"):
        assert value(text.python_repr(lit(s))) == repr(s)
    assert value(text.one_or_list_repr(ints(3), lit(True))) == "[3]"


def test_names(value):
    title, author = lit("Pour lire saint Augustin"), lit("M.-D. Chenu")
    assert value(text.name(title, author), text.name(title, author, 4)) == ("Pour lire saint Augustin (M.-D. Chenu)", "Pour (M.-D)")
    assert value(text.slug(text.name(title, author, 8))) == "pour-lir-m-d-ch"
    assert value(text.slug(lit("L'École  œuvre!"))) == "l-ecole-oeuvre"
    assert value(text.journal_name(lit("La vie"), lit("1930"), lit(24), lit(0))) == "La vie 1930 vol. 24"


def test_first_of(value):
    cases = [F.array(lit("kiln")), F.array(lit("kiln"), lit("ash"), lit("salt")), lit(None).cast("array<string>"), F.array(none, lit("salt")), F.array(lit(""))]
    assert value(*map(text.first_of, cases)) == ("kiln", "kiln", None, None, None)


def test_toc_entries(value):
    cases = {"K. M. - Of Ash": ("K. M", "Of Ash"), "B. OKOYE. Salt and Sand": ("B", "OKOYE. Salt and Sand"), "Glazes": ("", "Glazes"), "Part\nII\nof kilns. - Ash": ("of kilns", "Ash")}
    for line, want in cases.items():
        assert value(*text.toc_entry(lit(line))) == want


def test_search_string(value):
    fields = {"publicationdate": lit("1930"), "title": lit("La vie spirituelle"), "editor": lit("x"), "publisher": lit(""), "recordtype": lit("per")}
    assert value(matching.search_string(fields)) == 'bib.publicationdate all "1930" and bib.title all "La vie spirituelle" and bib.recordtype all "per"'


PRETTY = [
    (range(1, 11), "1--10"), (range(450, 456), "450--5"), (range(450, 470), "450--69"), ([10, 11, 12, 13, 17, 18, 19], "10--3, 17--9"), (["i", "ii", "iii"], "i--iii"), ([1, 2, "i", "ii", "iii"], "1--2, i--iii"),
    (range(121, 132), "121--3"), ([12], "12--"),
]


def test_pretty_pages(value):
    assert value(*[ranges.pretty_pages(strings(p)) for p, _ in PRETTY]) == tuple(w for _, w in PRETTY)


def test_deprettify(value):
    for pages, shown in PRETTY[:4]:
        assert value(ranges.deprettify(lit(shown))) == list(pages)
    assert value(ranges.deprettify(lit("1135--57"))) == list(range(1135, 1158))
    assert value(ranges.deprettify(lit("1982"))) == [1982]


def test_bib_pages(value):
    cases = {"135--57": range(135, 158), "135-57": range(135, 158), "12": [12], "i-xi": "i ii iii iv v vi vii viii ix x xi".split(), "I--III": ["I", "II", "III"], "v-x": ["v-x"], "547--51": range(547, 552), "1135--57": []}
    for field, want in cases.items():
        assert value(ranges.bib_pages(lit(field))) == [str(w) for w in want]


def test_roman(spark):
    rows = spark.range(1, 4000).select("id", ranges.from_roman(ranges.to_roman(F.col("id"))).alias("back"), ranges.to_roman(F.col("id")).alias("r")).collect()
    assert all(r["id"] == r["back"] for r in rows)
    assert rows[1993]["r"] == "mcmxciv"
    assert spark.range(1).select(ranges.from_roman(lit("iiii"))).first()[0] is None


DESCRIPTIONS = [
    ("1922/10 (A4,T7,N37)-1923/03 (A4,T7,N42).", [1922, 1923], [7], list(range(37, 43))), ("1924/04 (A5,T10)-1924/09.", [1924], [10], None), ("1922/10 (A4,T7,N37)-1923/03 (A4,T8,N42).", [1922, 1923], [7, 8], list(range(37, 43))),
    ("1922/10 (A4,T7,N37).", [1922], [7], [37]), ("", None, None, None), ("1922/10 (T7).", [1922], [7], None),
]


def test_descriptions(value):
    for shown, *want in DESCRIPTIONS:
        got = ranges.describe(lit(shown))
        assert list(value(got["year"], got["volume"], got["number"])) == want


def test_catalogue_years(value):
    cases = {"1919-1945": list(range(1919, 1946)), "1919,1921-1922": [1919, 1921, 1922], "1919,1930-": [1930], "-1930": [1930], "1-2-3": None, "-": None}
    for shown, want in cases.items():
        assert value(ranges.catalogue_years(lit(shown))) == want
    assert value(ranges.year_window(ints(1936, 1937))) == [1935, 1936, 1937, 1938]


def test_arks(value):
    a = value(ark.parse_ark(lit("https://gal.example.org/ark:/12148/bpt6k9735634r.textePage".replace(".textePage", "/f5"))))
    assert (a["scheme"], a["authority"], a["naan"], a["name"], a["qualifier"], a["error"]) == ("https", "gal.example.org", "12148", "bpt6k9735634r", "f5", None)
    for bad in ("ark:/12148", "http:///ark:/1/2", "bpt6k", "ark:/1/2/3/4", "ark:/1/a#b"):
        assert value(ark.parse_ark(lit(bad)))["error"]
    p = ark.parse_ark(lit("ark:/1/2/q"))
    assert value(ark.ark_id(p), ark.ark_root(p), ark.ark_text(p), ark.is_ark_id(p)) == ("ark:/1/2/q", "ark:/1/2", "ark:/1/2/q", True)
    assert value(ark.build_url(lit("http://x"), {"a": lit("b c&é"), "n": none})) == "http://x?a=b+c%26%C3%A9"


def test_near_matches(value):
    hit = value(fuzzy.near_matches(lit("augustin"), lit("pour lire saint augnstin, dit augustin"), 2))
    assert [(h["matched"], h["dist"]) for h in hit] == [("augnstin", 1), ("augustin", 0)]
    assert value(fuzzy.near_matches(none, lit("x"), 2), fuzzy.near_matches(lit("abcdef"), lit("uvwxyz"), 2)) == ([], [])


@given(st.text("ab", min_size=1, max_size=6), st.text("abc", max_size=15), st.integers(0, 2))
@settings(max_examples=150, deadline=None)
def test_search_finds_what_there_is(needle, hay, k):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    best = min(distance(needle, hay[a:b]) for a in range(len(hay) + 1) for b in range(a, len(hay) + 1))
    hits = fuzzy.search(needle, hay, k)
    if hay:
        assert bool(hits) == (best <= k and (best < len(needle) or bool(hits)))
    for a, b, d in hits:
        assert distance(needle, hay[a:b]) == d <= k


def test_bibtex_article(value):
    c = {"publicationdate": ints(1930), "title": lit("Pour lire saint Augustin"), "journaltitle": lit("La vie spirituelle"), "pages": strings([135, 136, 137]), "author": lit("M.-D. Chenu"), "number": ints(1), "volume": ints(12)}
    fields = ["year = {1930}", "title = {Pour lire saint Augustin}", "journaltitle = {La vie spirituelle}", "pages = {135--7}", "author = {M.-D. Chenu}", "number = {1}", "volume = {12}"]
    assert value(report.bibtex_article(c)) == "@Article{pour-lir-m-d-ch,\n" + "".join(f"    {f},\n" for f in fields) + "}\n"
    assert value(report.page_count_note(lit(12)), report.page_count_note(lit(0))) == ("12 pp.", None)


def test_reports(value):
    args = lit("A & <b>"), lit("raw"), lit(True), lit("/x/processed-a.pdf"), none, lit("72.33 %")
    assert value(report.text_entry(*args)).split() == "==A & <b>== raw Processed: /x/processed-a.pdf Confidence: 72.33 %".split()
    assert "Failed to match :(" in value(report.text_entry(args[0], args[1], lit(None).cast("boolean"), none, none, none))
    page = value(report.html_entry(*args))
    assert "A &amp; &lt;b&gt;" in page and 'href="pdfs/processed-a.pdf"' in page
    org = value(report.org_entry(args[0], args[1], lit("ris"), lit("ark:/1/2"), *args[2:]))
    assert org.startswith("** DONE A & <b>") and 'ark = "ark:/1/2"' in org and "#+BEGIN_SRC ris" in org
    assert value(report.org_head(lit(1), lit(1))) == "* [1/1] Status\n"


def test_image_functions(value):
    assert value(*[imaging.image_format(lit(f)) for f in ("FlateDecode", "DCTDecode", "JPXDecode", "CCITTFaxDecode")], imaging.image_format(none)) == ("png", "jpg", "jp2", "tiff", "png")
    assert value(imaging.tone(lit(120)), imaging.tone(lit(100)), imaging.tone(lit(200))) == (100, 83, 255)


def test_sha_is_sha(value):
    assert value(text.key(lit("x"))) == hashlib.sha1(b"x").hexdigest()
