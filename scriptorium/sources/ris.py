"""RIS files as records, by expressions only once entries are cut out.

Lines 'XX  - value' are gathered into entries that 'ER' ends; tags that repeat
keep their order.  Authors are joined by 'and' without spaces.  The journal is
JO, else T2.  Entries of other types have `error` set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import ranges
from scriptorium.sources import entries
from scriptorium.sources.bibtex import numbered  # noqa: F401

# fixed values: reference type -> kind
KINDS = {"JOUR": "article", "BOOK": "book", "COLL": "collection"}
_LINE = r"^([A-Z][A-Z0-9])  - ?(.*)$"


def raw_entries(text: Column) -> Column:
    """The entries of a file: each up to a line that begins with 'ER', without blank lines."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda line: F.trim(line) != "")
    whole = F.array_join(F.transform(lines, lambda line: F.when(line.startswith("ER"), F.concat(line, F.lit("\u001e"))).otherwise(line)), "\n")
    return F.filter(F.transform(F.split(whole, "\u001e\n?"), lambda e: F.regexp_replace(e, r"^\n+|\n+$", "")), lambda e: e.rlike(r"(?m)^TY"))


def records(files: DataFrame, text: str = "value", file_pos: str = "file") -> DataFrame:
    """Records of files held in a text column, in order of file and place."""
    return fields(files.select(F.col(file_pos).alias("file"), F.posexplode(raw_entries(F.col(text))).alias("entry", "raw")))


def fields(raw: DataFrame) -> DataFrame:
    """Records of entries (file, entry, raw); those without a line 'TY' are none."""
    tags = F.filter(F.transform(F.split("raw", "\n"), lambda line: F.struct(F.regexp_extract(line, _LINE, 1).alias("tag"), F.trim(F.regexp_extract(line, _LINE, 2)).alias("value"))), lambda t: t["tag"] != "")
    read = raw.where(F.col("raw").rlike(r"(?m)^TY")).withColumn("tags", tags)
    every = lambda *names: F.transform(F.filter("tags", lambda t: t["tag"].isin(*names) & (t["value"] != "")), lambda t: t["value"])
    one = lambda *names: F.coalesce(*[F.get(every(n), F.lit(0)) for n in names])
    ints = lambda c: F.when(c.isNotNull(), F.array(c))
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[one("TY")]
    no = F.lit(False)
    year = F.regexp_extract(one("PY", "Y1"), r"(\d{4})", 1).try_cast("int")
    pages = ranges.span(one("SP").try_cast("int"), one("EP").try_cast("int")).cast("array<string>")
    found = read.select(
        "file", "entry", kind.alias("kind"), F.lit("ris").alias("input"), "raw", one("TI", "T1").alias("title"), F.lit(None).cast("string").alias("subtitle"), one("JO", "T2").alias("journaltitle"),
        F.array_join(every("AU", "A1"), "and").alias("author"), one("ED").alias("editor"), one("PB").alias("publisher"), one("CY").alias("location"), F.lit(None).cast("int").alias("page_count"), F.lit(None).cast("string").alias("ark"),
        ints(year).alias("publicationdate"), no.alias("publicationdate_is_list"), ints(one("IS").try_cast("int")).alias("number"), no.alias("number_is_list"), ints(one("VL").try_cast("int")).alias("volume"), no.alias("volume_is_list"),
        F.when(one("SP").isNotNull(), pages).alias("pages"), F.lit(None).cast("array<int>").alias("physical_pages"), (one("SP").try_cast("int").isNotNull() & one("EP").try_cast("int").isNotNull() & pages.isNull()).alias("pages wide"),
    )
    return found.withColumn("error", F.when(F.col("kind").isNull(), "Unsupported type").when(F.col("pages wide"), ranges.TOO_WIDE)).drop("pages wide")


def read_ris(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records of the .ris files at path, unless the option `suffix` says otherwise; `file` is the file's address, `entry` the place in bytes."""
    return fields(entries.load(spark, entries.Ris, path, **options))
