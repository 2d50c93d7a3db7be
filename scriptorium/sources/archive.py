"""Tables of an archive: what its services give, as files or as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium import schema
from scriptorium.functions import ark as arks
from scriptorium.sources import bibtex, entries, ris

#: Reader of a file's records by the end of its name; register_reader adds to it.
READERS: dict[str, Callable[..., DataFrame]] = {".bib": bibtex.records, ".ris": ris.records}
#: Formats that are read in byte ranges, by the end of a file's name, with what makes records of their entries; register_format adds to it.
FORMATS: dict[str, tuple[type[entries.Entries], Callable[[DataFrame], DataFrame]]] = {".bib": (entries.Bibtex, bibtex.fields), ".ris": (entries.Ris, ris.fields)}
#: What an image service can be asked for; fixed values.
IMAGE_FORMATS = ("png", "tif", "jpg", "gif")
_INFO = "width int, height int, `@id` string"


def register_reader(suffix: str, reader: Callable[..., DataFrame]) -> None:
    """Files that end so are read by reader(files, text column, file column), which gives records."""
    READERS[suffix.lower()] = reader


def register_format(form: type[entries.Entries], fields: Callable[[DataFrame], DataFrame]) -> None:
    """Files that end as the format says are read in byte ranges; fields(entries) makes records of file, entry and raw."""
    FORMATS[form.ends.lower()] = (form, fields)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files at path, each read by the end of its name; of other files, one row with an error."""
    out = None
    for form, fields in FORMATS.values():
        part = bibtex.numbered_in_ranges(fields(entries.load(spark, form, path)))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    whole = [suffix for suffix in READERS if suffix not in FORMATS]
    for suffix in whole:
        files = spark.read.option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True).withColumn("file", F.input_file_name())
        out = out.unionByName(bibtex.numbered(READERS[suffix](files, "value", "file")), allowMissingColumns=True)
    names = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    known = F.greatest(F.lit(False), *[F.lower("file").endswith(s) for s in (*FORMATS, *whole)])
    return out.unionByName(names.where(~known).select("file", F.lit("Unsupported type").alias("error"), F.lit(0).alias("entry"), F.lit(0).alias("pos")), allowMissingColumns=True)


def records(files: DataFrame, text: str = "value", file: str = "file") -> DataFrame:
    """The same of a table of file names and texts."""
    ends = lambda s: F.lower(file).endswith(s)
    parts = [reader(files.where(ends(s)), text, file) for s, reader in READERS.items()]
    other = files.where(~F.coalesce(F.greatest(*[ends(s) for s in READERS], F.lit(False)), F.lit(False)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    none = other.select(F.col(file).alias("file"), F.lit("Unsupported type").alias("error"))
    return bibtex.numbered(out.unionByName(none.withColumn("entry", F.lit(0)), allowMissingColumns=True))


def read_issue_meta(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of issues from JSON lines; rows of other shapes have nulls."""
    return spark.read.schema(schema.ISSUE_META).json(path)


def issue_meta(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """The same from a column of JSON, with an error for what is none."""
    read = raw.withColumn("m", F.from_json(payload, schema.ISSUE_META + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    return read.select("m.ark", "m.title", "m.publisher", "m.identifier", "m.description", F.when(F.col("m._corrupt_record").isNotNull() | F.col("m").isNull(), "not readable").alias("error"))


def image_info(payload: Column) -> Column:
    """Width and height an image service states, as a struct; 1 x 1 where it cannot be read."""
    info = F.from_json(payload, _INFO)
    return F.struct(F.coalesce(info["width"], F.lit(1)).alias("width"), F.coalesce(info["height"], F.lit(1)).alias("height"))


def image_address(ark: Column, view: Column, region: Column, size: str = "full", rotation: int = 0, quality: str = "native", image_format: str = "png") -> Column:
    """Path of a region (x, y, width, height) of a view; a qualifier is left out."""
    if image_format not in IMAGE_FORMATS:
        raise ValueError(f"not an image format: {image_format}")
    box = F.array_join(F.array(*[region[k] for k in ("x", "y", "width", "height")]).cast("array<string>"), ",")
    return F.concat(F.lit("iiif/"), arks.ark_root(ark), F.lit("/f"), view.cast("string"), F.lit("/"), box, F.lit(f"/{size}/{rotation}/{quality}.{image_format}"))


def whole_image(info: Column) -> Column:
    """The region that is all of an image."""
    return F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), info["width"].alias("width"), info["height"].alias("height"))


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Image files: path, name, length and content; the content is read only where it is used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")
