"""Files of entries in byte ranges: every cut gives the whole file's entries."""

import io
import random

import pytest

from scriptorium.sources import archive, bibtex, entries, ris
from scriptorium.streaming import watch

BIB = """% heading
@article{one, title = {Glazes of the {North}}, author = "B. Okoye",
  journal = {Kilns}, year = 1931,

  pages = {12--19}}
 @book{two, title={Salt @ home}, year={1930}, author={É. Müller}}

trailing @ line
@misc{three, title={x}}
@article{four, title={Ash}, author={C}, journal={Kilns}, year={1933}, pages={4}}"""
RIS = "junk\nTY  - JOUR\nTI  - Ash\nAU  - Okoye, B.\nSP  - 3\nEP  - 5\nER  - \n\n\nTY  - BOOK\r\nTI  - Salt\r\nER  -\nER  - \nTY  - COLL\nTI  - last without an end\n"


def cut(form, data, borders):
    out = []
    for start, end in zip(borders, [*borders[1:], len(data)], strict=True):
        out += form.entries(io.BufferedReader(io.BytesIO(data)), start, end)
    return out


@pytest.mark.parametrize(("form", "text"), [(entries.Bibtex.borders(), BIB), (entries.Ris.borders(), RIS)])
@pytest.mark.parametrize("end", ["", "\n", "\n\n  \n"])
def test_every_cut_gives_the_same(form, text, end):
    data = (text + end).encode()
    whole = cut(form, data, [0])
    assert b"".join(e for _, e in whole) == data
    for k in range(1, len(data)):
        assert cut(form, data, [0, k]) == whole
    rng = random.Random(2)
    for _ in range(100):
        assert cut(form, data, [0, *sorted(rng.sample(range(1, len(data)), 4))]) == whole
    assert cut(form, data, list(range(len(data)))) == whole


def test_long_lines_are_found_backwards(monkeypatch):
    monkeypatch.setattr(entries, "_BACK", 3)
    form, data = entries.Ris.borders(), RIS.encode()
    for k in range(1, len(data)):
        assert cut(form, data, [0, k]) == cut(form, data, [0])


@pytest.mark.parametrize("most", [97, 10**9])
def test_files_equal_the_whole_file_reader(spark, tmp_path, most):
    for k in range(3):
        (tmp_path / f"a{k}.bib").write_text(BIB * (k + 1))
        (tmp_path / f"b{k}.ris").write_bytes((RIS * (k + 1)).encode())
    (tmp_path / "none.bib").write_text("")
    for reader, module, suffix in ((bibtex.read_bibtex, bibtex, "bib"), (ris.read_ris, ris, "ris")):
        found = reader(spark, str(tmp_path), splitBytes=most)
        assert (most > 97) == (found.rdd.getNumPartitions() == 1)
        files = spark.read.option("pathGlobFilter", f"*.{suffix}").text(str(tmp_path), wholetext=True).selectExpr("value", "_metadata.file_path file")
        want = bibtex.numbered(module.records(files)).drop("file", "entry").exceptAll(bibtex.numbered_in_ranges(found, span=64).drop("file", "entry"))
        assert want.isEmpty() and found.count() == module.records(files).count() > 6


def test_a_format_of_ones_own(spark, tmp_path):
    class Cards(entries.Entries):
        opens = rb"Card "
        ends = ".card"

        @classmethod
        def name(cls):
            return "cards"

    (tmp_path / "x.card").write_text("Card 1\ntitle A\nCard 2\ntitle B\n")
    (tmp_path / "y.bib").write_text(BIB)
    (tmp_path / "z.pdf").write_text("?")
    archive.register_format(Cards, lambda raw: raw.selectExpr("file", "entry", "'book' AS kind", "split(raw, 'title ')[1] AS title", "raw", "CAST(NULL AS STRING) AS error"))
    try:
        rows = archive.read_records(spark, str(tmp_path)).select("title", "error", "pos").collect()
    finally:
        del archive.FORMATS[".card"]
    assert sorted((r["title"], r["pos"]) for r in rows if r["title"] in ("A", "B")) == [("A", 0), ("B", 1)]
    assert [r["pos"] for r in rows if r["error"] == "Unsupported type"].count(0) == 1
    with pytest.raises(ValueError, match="lines"):
        entries.Format()


def test_a_stream_reads_on_where_it_was(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        query = watch.start_matching(watch.record_stream(spark, str(folder)), lambda batch: batch.select("title", "kind"), out, state)
        query.awaitTermination()
        return sorted(r["title"] for r in spark.read.parquet(out).where("title IS NOT NULL").collect())

    (folder / "a.bib").write_text("@book{x, title={A}, year=1930}\n")
    assert run() == ["A"]
    with (folder / "a.bib").open("a") as more:
        more.write("@book{y, title={B}, year=1931}\n")
    (folder / "b.ris").write_text("TY  - BOOK\nTI  - C\nER  -\n")
    assert run() == ["A", "B", "C"]
    assert run() == ["A", "B", "C"]


def test_no_files(spark, tmp_path):
    assert bibtex.read_bibtex(spark, str(tmp_path)).count() == 0
