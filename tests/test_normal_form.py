"""The normal form of every document, against unicodedata."""

import unicodedata

from scriptorium.plans import catalogue

DOCS = [
    (1, "  The Éditor’s ﬁrst Ⅷ days\n"), (2, "Plain ASCII Text\t"), (3, "Où est l’Œuvre ÉLÉMENTAIRE ?"), (4, " Straße, Übermaß, ÄÖÜ  "), (5, "¿Qué Año? Ñandú, pingüino½"),
    (6, None), (7, ""), (8, "İstanbul ΑΣ"), (9, "é ñ"), (None, "Sans clé"), (3, "again, ÉTÉ"), (10, " 　 "),
]


def plain(s):
    return unicodedata.normalize("NFKD", s).lower().strip() if s else None


def test_normal_form_of_every_document(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.QUERIES["normalize_text"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(d, plain(s)) for d, s in DOCS], key=repr)


def test_normal_form_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    found = catalogue.QUERIES["normalize_text"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(docs) and {r["doc_id"]: r["plain"] for r in found} == {r["doc_id"]: plain(r["text"]) for r in docs}
