"""BibTeX files as records.

`read_bibtex` reads files in byte ranges, a large one by many tasks; texts of a
column split into entries on the JVM side.  An entry's fields, with braces,
quotes and accents, are read by an Arrow UDF.  Each entry is a row, with its place in
`entry`; entries of other types, or that cannot be read, have `error` set and no
fields.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import ranges
from scriptorium.sources import entries

KINDS = ("article", "book", "collection")
# fixed values: accent commands and their combining marks, and commands that are letters
_ACCENTS = {"`": "̀", "'": "́", "^": "̂", '"': "̈", "~": "̃", "=": "̄", "u": "̆", ".": "̇", "v": "̌", "c": "̧", "r": "̊", "H": "̋", "k": "̨"}
_LETTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "i": "ı", "&": "&", "%": "%", "$": "$", "#": "#", "_": "_"}
_ACCENT = re.compile(r"""\{?\\([`'^"~=.]|[uvcrHk](?![A-Za-z]))\s*(?:\{\s*(\\?[A-Za-z])\s*\}|(\\?[A-Za-z]))\}?""")
_COMMAND = re.compile(r"\{?\\(?:(ss|ae|AE|oe|OE|aa|AA|[oOlLi])(?![A-Za-z])\s*(?:\{\})?|([&%$#_]))\}?")
_FIELDS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType())])


def from_latex(text: str) -> str:
    """Accents and letters as characters, without the braces around them."""
    accent = lambda m: unicodedata.normalize("NFC", (m[2] or m[3]).lstrip("\\") + _ACCENTS[m[1]])
    out = _COMMAND.sub(lambda m: _LETTERS[m[1] or m[2]], _ACCENT.sub(accent, text))
    return out.replace("{", "").replace("}", "")


def read_entry(raw: str) -> dict:
    """Kind, key and fields of one entry."""
    head = re.match(r"\s*@\s*(\w+)\s*[{(]\s*([^,\s]*)\s*,", raw)
    if not head:
        return {"kind": None, "key": None, "fields": None, "error": "Unable to parse"}
    kind, at, fields = head[1].lower(), head.end(), {}
    name = re.compile(r"\s*,?\s*([A-Za-z][\w:-]*)\s*=\s*")
    while m := name.match(raw, at):
        at, parts = m.end(), []
        while at < len(raw):
            sign = raw[at]
            if sign in '{"':
                depth, start = int(sign == "{"), at + 1
                at = start
                while at < len(raw) and (depth > 0 if sign == "{" else raw[at] != '"' or depth > 0):
                    depth += (raw[at] == "{") - (raw[at] == "}")
                    at += 1
                parts.append(raw[start : at - 1 if sign == "{" else at])
                at += sign == '"'
            else:
                bare = re.compile(r"[^,}\s#]+").match(raw, at)
                if not bare:
                    break
                parts.append(bare[0])
                at = bare.end()
            joint = re.compile(r"\s*#\s*").match(raw, at)
            if not joint:
                break
            at = joint.end()
        fields[m[1].lower()] = re.sub(r"\s+", " ", from_latex("".join(parts))).strip()
    if kind not in KINDS:
        return {"kind": kind, "key": head[2], "fields": None, "error": "Unsupported type"}
    return {"kind": kind, "key": head[2], "fields": fields, "error": None}


@F.pandas_udf(_FIELDS)
def entry_fields(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_entry(r or "") for r in raw], columns=["kind", "key", "fields", "error"])


def raw_entries(text: Column) -> Column:
    """The entries of a file: each from a line that begins with '@' to the next, without blank lines."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda line: F.trim(line) != "")
    marked = F.transform(lines, lambda line: F.when(F.ltrim(line).startswith("@"), F.concat(F.lit("\u001e"), line)).otherwise(line))
    return F.filter(F.split(F.array_join(marked, "\n"), "\n?\u001e"), lambda entry: entry != "")


def records(files: DataFrame, text: str = "value", file_pos: str = "file") -> DataFrame:
    """Records of files held in a text column, in order of file and place."""
    return fields(files.select(F.col(file_pos).alias("file"), F.posexplode(raw_entries(F.col(text))).alias("entry", "raw")))


def fields(raw: DataFrame) -> DataFrame:
    """Records of entries (file, entry, raw)."""
    f = lambda k: F.nullif(F.col("e.fields")[k], F.lit(""))
    lists = ("year", "number", "volume")
    # read once, in a projection of their own
    read = raw.withColumn("e", entry_fields("raw")).withColumns({**{f"{k} list": ranges.deprettify(f(k)) for k in lists}, "page list": F.when(f("pages").isNotNull(), ranges.bib_pages(f("pages")))})
    many = lambda k: F.filter(f"{k} list", lambda x: x.isNotNull())
    listed = lambda k: F.coalesce(F.size(many(k)) > 1, F.lit(False))
    wide = reduce(lambda a, b: a | b, [f(k).isNotNull() & F.col(f"{k} list").isNull() for k in lists]) | (f("pages").isNotNull() & F.col("page list").isNull())
    return read.select(
        "file", "entry", F.col("e.kind").alias("kind"), F.lit("bibtex").alias("input"), "raw", f("title").alias("title"), f("subtitle").alias("subtitle"), F.coalesce(f("journaltitle"), f("journal")).alias("journaltitle"),
        f("author").alias("author"), f("editor").alias("editor"), f("publisher").alias("publisher"), F.coalesce(f("location"), f("address")).alias("location"), f("page_count").try_cast("int").alias("page_count"), f("ark").alias("ark"),
        many("year").alias("publicationdate"), listed("year").alias("publicationdate_is_list"), many("number").alias("number"), listed("number").alias("number_is_list"), many("volume").alias("volume"), listed("volume").alias("volume_is_list"),
        F.col("page list").alias("pages"), F.lit(None).cast("array<int>").alias("physical_pages"), F.coalesce(F.col("e.error"), F.when(wide, ranges.TOO_WIDE)).alias("error"),
    )


def numbered(found: DataFrame) -> DataFrame:
    """Adds pos, the place of a record in its file."""
    return found.withColumn("pos", F.row_number().over(Window.partitionBy("file").orderBy("entry")) - 1)


def numbered_in_ranges(found: DataFrame, span: int = entries.SPLIT_BYTES) -> DataFrame:
    """The same where `entry` is a place in bytes: a file is numbered in ranges of `span` bytes, on what stands before each."""
    dealt = found.withColumn("range", F.floor(F.col("entry") / span))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("file", "range").agg(F.count("*").alias("n")).select("file", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    here = F.row_number().over(Window.partitionBy("file", "range").orderBy("entry"))
    return dealt.withColumn("here", here).join(base, ["file", "range"]).withColumn("pos", F.col("base") + F.col("here") - 1).drop("range", "here", "base")


def read_bibtex(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records of the .bib files at path, unless the option `suffix` says otherwise; `file` is the file's address, `entry` the place in bytes."""
    return fields(entries.load(spark, entries.Bibtex, path, **options))
