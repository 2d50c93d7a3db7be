import pytest
from pyspark.sql import functions as F

from scriptorium.operators import imaging, matching, pages, report, store
from scriptorium.sources import bibtex, markup, ris
from scriptorium.streaming import watch

BIB = r"""
  @ARTICLE{k-7,
  title = "On the {G}lazing of T{\"u}bingen Tiles", year = 1911, keywords = {tiles},
  author = {M{\'a}ria K{\H o}v{\'a}ri},

  volume = {3}, pages = "88--94",
  journaltitle = {Annals of Kiln Work}
  }
"""
RIS = """TY  - JOUR
PY  - 1967/05
AU  - Kővári, M.
SP  - 12
EP  - 19
AU  - Okoye, B.
T2  - A Second Name
JO  - Kilns Quarterly
TI  - Ash glazes
IS  - 2
VL  - 9
ER  -

TY  - ABST
TI  - x
SP  - 1
EP  - 2
ER  -
"""


def files(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "file int, value string")


def test_bibtex(spark):
    rows = bibtex.numbered(bibtex.records(files(spark, "\n\n".join([BIB] * 3)))).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == [0, 1, 2]
    r = rows[1]
    assert (r["kind"], r["author"], r["title"], r["journaltitle"], r["error"]) == ("article", "Mária Kővári", "On the Glazing of Tübingen Tiles", "Annals of Kiln Work", None)
    assert (r["publicationdate"], r["publicationdate_is_list"], r["volume"], r["number"]) == ([1911], False, [3], None)
    assert r["pages"] == [str(p) for p in range(88, 95)]
    assert r["raw"].split("\n") == [
        "  @ARTICLE{k-7,",
        '  title = "On the {G}lazing of T{\\"u}bingen Tiles", year = 1911, keywords = {tiles},',
        "  author = {M{\\'a}ria K{\\H o}v{\\'a}ri},",
        '  volume = {3}, pages = "88--94",',
        "  journaltitle = {Annals of Kiln Work}",
        "  }",
    ]


def test_bibtex_errors(spark):
    rows = bibtex.records(files(spark, "@inbook{x, title={y}, pages={1}, year=1930}", "nonsense", "@book{k, title = {A} # { B}, author=x, year = {1930--32}}")).orderBy("file").collect()
    assert [r["error"] for r in rows] == ["Unsupported type", "Unable to parse", None]
    assert (rows[2]["title"], rows[2]["publicationdate"], rows[2]["publicationdate_is_list"], rows[2]["pages"]) == ("A B", [1930, 1931, 1932], True, None)


@pytest.mark.parametrize(("latex", "plain"), [(r"Dani{\'e}lou", "Daniélou"), (r"\`a \^{o} {\"u}", "à ô ü"), (r"\c{c}a {\oe}uvre \ss{} \& {\v{s}}", "ça œuvre ß & š")])
def test_latex(latex, plain):
    assert bibtex.from_latex(latex) == plain


def test_ris(spark):
    rows = ris.numbered(ris.records(files(spark, RIS))).orderBy("pos").collect()
    r = rows[0]
    assert (r["kind"], r["author"], r["journaltitle"], r["volume"], r["number"], r["publicationdate"]) == ("article", "Kővári, M.andOkoye, B.", "Kilns Quarterly", [9], [2], [1967])
    assert r["pages"] == [str(p) for p in range(12, 20)]
    assert r["raw"].startswith("TY  - JOUR") and r["raw"].rstrip().endswith("ER  -")
    assert rows[1]["error"] == "Unsupported type"


def test_readers_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.bib").write_text(BIB * 2)
    assert bibtex.read_bibtex(spark, str(folder)).count() == 2
    stream = watch.distinct_records(watch.record_stream(spark, str(folder)))
    watch.start_matching(stream, lambda batch: batch.select("title", "key"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


ROWS = """<table><row><cell><seg>A. One</seg></cell><cell><xref> 1
</xref></cell></row><row><cell><seg>No page</seg></cell></row><row><cell/></row></table>"""
ITEMS = "<list xmlns:a='b'c='><ITEM><seg> Two\n lines </seg><xref>5</xref><xref>6</xref></item><item><xref>7</xref></item><div><item><seg>In</seg><xref>9</xref></item></div>"


def test_markup():
    links = markup.toc_entries('<nav><ul><li><a href="/x">X &amp; y</a><li><a>none</a></li></ul>', markup.PageLinks)
    assert {"pno": "/x", "title": "X & y"} in links and {"pno": "", "title": "none"} in links
    assert markup.toc_entries(ROWS) == [{"pno": "1", "title": "A. One"}]
    assert markup.toc_entries(ITEMS)[-1] == {"pno": "9", "title": "In"}
    assert {"pno": "5", "title": "Two\n lines"} in markup.toc_entries(ITEMS.replace(" xmlns:a='b'c='", ""))
    assert markup.text_after_rule("<body>a<hr>b<p>c</p><hr/>d</body>") == "b c d"
    assert markup.text_after_rule("none") == ""
    alto = '<alto><Page WIDTH="1852" HEIGHT="3088"><PrintSpace HPOS="187" VPOS="628" WIDTH="1450" HEIGHT="2138"></PrintSpace></Page></alto>'
    assert markup.text_box(alto) == {"upper": {"x": 187, "y": 628}, "lower": {"x": 1637, "y": 2766}, "total_width": 1852, "total_height": 3088}
    assert markup.text_box("<alto/>") is None


def test_early_exit_and_best(spark):
    scores = {"a": [0.1, 0.9, 0.2, 0.3, 0.4, 0.95], "b": [0.1] * 60, "c": [0.5, 0.5], "d": [0.1] * 5 + [0.8, 0.99]}
    frame = spark.createDataFrame([(t, k, s) for t, row in scores.items() for k, s in enumerate(row)], "target string, pos int, score double")
    seen = {r["target"]: r["n"] for r in matching.early_exit(frame, "target", "pos").groupBy("target").agg(F.count("*").alias("n")).collect()}
    assert seen == {"a": 5, "b": 50, "c": 2, "d": 6}
    best = {r["target"]: r["pos"] for r in matching.best_match(frame, "target", "pos").collect()}
    assert best == {"a": 1, "b": 0, "c": 0, "d": 5}


def test_article_candidates(spark):
    rows = [("t", 1, 0, 0.3), ("t", 1, 1, 0.6), ("t", 2, 2, 0.8), ("t", 2, 3, 0.2), ("t", 3, 4, 0.99), *[("u", 1, k, 0.1 * k) for k in range(8)]]
    got = matching.article_candidates(spark.createDataFrame(rows, "target string, issue int, pos int, score double"), "target", "issue", "pos").orderBy("target", "rank").collect()
    assert [(r["target"], r["pos"]) for r in got] == [("t", 2), ("t", 1), ("t", 0), ("t", 3), ("u", 7), ("u", 6), ("u", 5), ("u", 4), ("u", 3)]


def test_page_lookup(spark):
    m = spark.createDataFrame([("x", k, n, k + 7, t) for k, (n, t) in enumerate([("", "N"), ("10", "A"), ("10", "A"), ("11", "R")])], "ark string, pos int, numero string, ordre int, pagination_type string")
    wanted = spark.createDataFrame([("x", "10"), ("x", "99")], "ark string, pno string")
    assert {r["pno"]: r["ordre"] for r in pages.physical_pages(wanted, m).collect()} == {"10": 8, "99": 10}
    assert pages.last_page(m).first()["last_pno"] == 9
    assert pages.last_page(m.where("pagination_type = 'N'")).first()["last_pno"] == 7


def test_toc_articles(spark):
    e = spark.createDataFrame([("x", 0, "5", "A. - T"), ("x", 1, "5", "B. - U"), ("x", 2, "6", "C")], "ark string, pos int, pno string, title string")
    last = spark.createDataFrame([("x", 8)], "ark string, last_pno int")
    got = pages.toc_articles(e, last, F.lit("5")).orderBy("pos").collect()
    assert [(r["author"], r["title"], r["first_page"], r["last_page"]) for r in got] == [("A", "T", 5, 4), ("B", "U", 5, 8)]
    listed = pages.toc_articles(e, last, F.lit("5")).orderBy("pos").select(pages.page_list(F.col("first_page"), F.col("last_page")).alias("p")).collect()
    assert [r["p"] for r in listed] == [[], ["5", "6", "7", "8"]]


def test_plans(spark):
    s = spark.createDataFrame([(0, 20), (0, 3), (5, 4)], "a int, b int")
    got = pages.block_plan(s, "a", "b", 5).collect()
    assert [(r["block_start"], r["block_len"]) for r in got if r["b"] == 20] == [(0, 5), (5, 5), (10, 5), (15, 5), (20, 1)]
    assert [r["block_len"] for r in pages.block_plan(s, "a", "b").collect() if r["b"] == 3] == [4]
    parts = spark.createDataFrame([("d", b, p) for b in range(2) for p in range(4)], "doc string, block_no int, page_idx int")
    assert [(r["block_no"], r["page_idx"]) for r in pages.merged_pages(parts, "doc").orderBy("out_page").collect()] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 2), (1, 3)]
    assert pages.merged_pages(parts, "doc", True).count() == 4


def test_deanomalised(spark):
    rows = [("a", v) for v in (0, 1, 1, 5)] + [("b", 1)] * 3 + [("c", 12)]
    got = imaging.deanomalised(spark.createDataFrame(rows, "k string, v int"), ["k"], "v").collect()
    assert {r["k"]: r["value"] for r in got} == {"a": 1, "b": 1, "c": 12}


def test_ocr_crop(spark):
    dark = lambda y: 0 if 20 <= y < 24 or 40 <= y < 160 or 172 <= y < 175 else 255
    pixels = spark.createDataFrame([("p", x, y, dark(y)) for y in range(200) for x in range(4)], "doc string, x int, y int, v int")
    boxes = spark.createDataFrame([("p", (0, 30), (3, 165), 4, 200, 4, 200)], "doc string, upper struct<x:int,y:int>, lower struct<x:int,y:int>, total_width int, total_height int, width int, height int")
    got = imaging.ocr_crop(pixels, boxes, ["doc"]).first()
    assert (got["ux"], got["lx"]) == (-10, 13)
    assert got["uy"] <= 20 - 0 and got["ly"] >= 175


def test_store(spark):
    log = spark.createDataFrame([("k", "a", 1), ("k", "b", 2), ("m", "c", 1)], "key string, value string, version int")
    log = store.put(log, spark.createDataFrame([("m", "d", 5)], log.schema))
    wanted = spark.createDataFrame([("k",), ("m",), ("z",)], "key string")
    got = {r["key"]: (r["stored"], r["hit"]) for r in store.probe(wanted, log, "key", "value", "version", F.lit("none")).collect()}
    assert got == {"k": ("b", True), "m": ("d", True), "z": ("none", False)}
    assert [r["key"] for r in store.misses(wanted, log, "key").collect()] == ["z"]
    assert store.misses(wanted, log, "key", ignore=True).count() == 3


def test_names_and_report(spark, tmp_path):
    frame = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a"), (3, "b")], "pos int, slug string")
    names = lambda first: [r["filename"] for r in report.numbered_names(frame, "slug", "pos", ".pdf", first).orderBy("pos").collect()]
    assert names(1) == ["a.pdf", "a-1.pdf", "a-2.pdf", "b.pdf"]
    assert names(0) == ["a.pdf", "a-0.pdf", "a-1.pdf", "b.pdf"]
    held = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a-1"), (3, "a"), (4, "a-1"), (5, "c")], "pos int, slug string")
    numbered = report.numbered_names(held, "slug", "pos", ".pdf")
    assert [r["filename"] for r in numbered.orderBy("pos").collect()] == ["a.pdf", "a-2.pdf", "a-1.pdf", "a-3.pdf", "a-1-1.pdf", "c.pdf"]
    on_disk = spark.createDataFrame([("c",), ("c-0",), ("z",)], "slug string")
    assert [r["filename"] for r in report.numbered_names(held, "slug", "pos", ".pdf", 0, taken=on_disk).orderBy("pos").collect()][-1] == "c-1.pdf"
    report.write_report(frame.withColumn("entry", F.col("slug")), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.split() == ["Status", "Report", "-------------", "a", "a", "a", "b"]


def test_catalogue_journals(spark):
    kind = [("fre", "publication en série imprimée")]
    rows = [(0, ["ark:/1/2"], ["La vie"], None, "1919-1945", ["fre", "français"], kind), (1, ["x"], ["y"], [], "1930", ["fre"], [("fre", "livre")]), (2, ["x"], ["y"], [], "1-2-3", ["fre"], kind)]
    from scriptorium.schema import CATALOGUE

    good, rest = matching.catalogue_journals(spark.createDataFrame(rows, CATALOGUE))
    r = good.first()
    assert (r["ark"], r["journaltitle"], r["publisher"], r["language"], r["publicationdate"]) == ("ark:/1/2", "La vie", None, "français", list(range(1919, 1946)))
    assert sorted(x["pos"] for x in rest.collect()) == [1, 2]
