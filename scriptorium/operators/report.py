"""Reports, exports and file names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import ranges, text


def html_escape(value: Column) -> Column:
    """As templates escape; the ampersand first."""
    out = value
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def _line(condition: Column, *parts) -> Column:
    return F.when(condition, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")


def _file(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def text_entry(name: Column, raw: Column, status: Column, processed: Column, unprocessed: Column, confidence: Column) -> Column:
    """One result of the plain report; no match and a failed download look alike."""
    good = F.concat(_line(processed.isNotNull(), "  Processed: ", processed, "\n"), _line(unprocessed.isNotNull(), "  Unprocessed: ", unprocessed, "\n"), F.lit("  Confidence: "), F.coalesce(confidence, F.lit("")), F.lit("\n"))
    return F.concat(F.lit("\n  =="), name, F.lit("==\n\n"), raw, F.lit("\n\n"), F.when(F.coalesce(status, F.lit(False)), good).otherwise("  Failed to match :(\n"))


def org_entry(name: Column, raw: Column, kind: Column, ark: Column, status: Column, processed: Column, unprocessed: Column, confidence: Column) -> Column:
    """One result of the outline report."""
    done = F.coalesce(status, F.lit(False))
    links = F.concat(F.lit("\n   [["), F.coalesce(processed, F.lit("None")), F.lit("][Processed Pdf]] "), _line(unprocessed.isNotNull(), "[[", unprocessed, "][Original Pdf]]"), F.lit("  Confidence: "), F.coalesce(confidence, F.lit("")), F.lit("\n"))
    return F.concat(
        F.lit("** "), F.when(done, "DONE ").otherwise("TODO "), name, F.lit("\n\n   #+BEGIN_SRC "), kind, F.lit("\n"), raw, F.lit("\n   #+END_SRC\n\n   #+BEGIN_SRC python\nark = \""), F.coalesce(ark, F.lit("")), F.lit("\"\n   #+END_SRC\n"),
        F.when(done, links).otherwise(""),
    )


def html_entry(name: Column, raw: Column, status: Column, processed: Column, unprocessed: Column, confidence: Column) -> Column:
    """One result of the web report, escaped."""
    link = lambda path, label: _line(path.isNotNull(), '<a href="pdfs/', html_escape(_file(path)), f'">{label}</a>\n')
    good = F.concat(link(processed, "Processed Pdf"), link(unprocessed, "Unprocessed Pdf"), F.lit("Confidence: "), F.coalesce(html_escape(confidence), F.lit("")), F.lit("\n"))
    return F.concat(F.lit("<h2>"), html_escape(name), F.lit("</h2>\n<pre><code>\n"), html_escape(raw), F.lit("\n</code></pre>\n"), F.when(F.coalesce(status, F.lit(False)), good).otherwise("Unable to download pdf :(\n"))


def org_head(successful: Column, total: Column) -> Column:
    return F.concat(F.lit("* ["), successful.cast("string"), F.lit("/"), total.cast("string"), F.lit("] Status\n"))


TEXT_HEAD = "                                 Status Report\n                                 -------------\n"


def html_head(title: str = "Status report") -> str:
    return f"<h1>{title}</h1>\n"


def write_report(entries: DataFrame, path: str, pos: str = "pos", entry: str = "entry", head: str = TEXT_HEAD) -> None:
    """Entries in order as text files under path; range-partitioned, so no task holds all of them."""
    lines = entries.select(F.col(pos).cast("long").alias("pos"), F.col(entry).alias("value"))
    first = entries.sparkSession.createDataFrame([(-1, head)], "pos long, value string")
    first.unionByName(lines).orderBy("pos").select("value").write.mode("overwrite").text(path)


def status_counts(results: DataFrame, status: str = "status") -> DataFrame:
    """successful (every result, as reports count it), total, matched (status true), failed, unmatched, progress."""
    c = F.col(status)
    return results.agg(
        F.count("*").alias("successful"), F.count("*").alias("total"), F.count_if(c).alias("matched"), F.count_if(~c).alias("failed"), F.count_if(c.isNull()).alias("unmatched"), F.avg(c.isNotNull().cast("int")).alias("progress")
    )


def deduplicated(results: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The first of equal results."""
    rest = [c for c in results.columns if c not in keys and c != pos]
    return results.groupBy(*keys).agg(F.min(pos).alias(pos), *[F.min_by(c, pos).alias(c) for c in rest])


def bibtex_entry(kind: Column, key: Column, fields: dict[str, Column]) -> Column:
    """A BibTeX entry; null, empty and zero fields are left out."""
    rows = F.array(*[F.when((F.length(v.cast("string")) > 0) & (v.cast("string") != "0"), F.concat(F.lit(f"    {k} = {{"), v.cast("string"), F.lit("},\n"))) for k, v in fields.items()])
    return F.concat(F.lit("@"), F.initcap(kind), F.lit("{"), key, F.lit(",\n"), F.array_join(rows, ""), F.lit("}\n"))


def _one_or_range(values: Column) -> Column:
    """A list of integers as a range, one integer as itself."""
    return F.when(F.size(values) > 1, ranges.prettify(values[0], F.element_at(values, -1), F.lit(False))).otherwise(F.get(values, F.lit(0)).cast("string"))


def bibtex_record(kind: str, c: dict[str, Column], omit: tuple[str, ...] = ()) -> Column:
    """A record's entry: key from title and author, pages as pretty ranges, lists of years as a range, without the fields to omit.

    Books and collections have a page count as a note; a newspaper's article is an
    article with a date and without pages.
    """
    many = {"publicationdate": "year", "number": "number", "volume": "volume"}
    order = {
        "article": ("publicationdate", "title", "journaltitle", "pages", "author", "number", "volume"),
        "book": ("publicationdate", "publisher", "title", "subtitle", "location", "note", "author", "editor"),
        "collection": ("publicationdate", "publisher", "title", "subtitle", "location", "note", "author", "editor"),
        "newspaperarticle": ("journaltitle", "date", "author", "title"),
    }[kind]
    shown = {k: _one_or_range(c[k]) if k in many else ranges.pretty_pages(c[k]) if k == "pages" else c[k] for k in order if k in c}
    if "page_count" in c and "note" in order:
        shown["note"] = page_count_note(c["page_count"])
    fields = {many.get(k, k): shown[k] for k in order if k in shown and k not in omit and many.get(k, k) not in omit}
    return bibtex_entry(F.lit("article" if kind == "newspaperarticle" else kind), text.slug(text.name(c["title"], c["author"], 8)), fields)


def bibtex_article(c: dict[str, Column]) -> Column:
    return bibtex_record("article", c)


def page_count_note(count: Column) -> Column:
    return F.when(F.coalesce(count, F.lit(0)) > 0, F.concat(count.cast("string"), F.lit(" pp.")))


def numbered_names(rows: DataFrame, slug: str, pos: str, suffix: str, first_number: int = 1, taken: DataFrame | None = None) -> DataFrame:
    """File names without collisions: the slug, then the slug with numbers from first_number.

    Numbers that would give another row's slug are passed over: of `a`, `a`, `a-1`
    the second becomes `a-2`.  taken: names (without suffix, in a column of the same
    name as the slug) that are in use and that no row may get.
    """
    ending = r"^(.*)-(0|[1-9][0-9]{0,8})$"
    used = rows.select(F.col(slug).alias("name")) if taken is None else rows.select(F.col(slug).alias("name")).union(taken.select(slug))
    skipped = used.distinct().where(F.col("name").rlike(ending)).groupBy(F.regexp_extract("name", ending, 1).alias("base")).agg(F.array_sort(F.collect_list(F.regexp_extract("name", ending, 2).cast("int"))).alias("skipped"))
    named = rows if taken is None else rows.join(taken.select(slug).distinct().withColumn("in use", F.lit(1)), slug, "left")
    extra = F.lit(0) if taken is None else F.coalesce("in use", F.lit(0))
    counted = named.withColumn("number", F.row_number().over(Window.partitionBy(slug).orderBy(pos)) - 1 + extra)
    held = counted.join(skipped, F.col(slug) == F.col("base"), "left")
    number = F.aggregate(F.coalesce("skipped", F.array().cast("array<int>")), F.col("number") - 1 + first_number, lambda k, n: F.when((n >= first_number) & (n <= k), k + 1).otherwise(k))
    tail = F.when(F.col("number") == 0, "").otherwise(F.concat(F.lit("-"), number.cast("string")))
    return held.withColumn("filename", F.concat(F.col(slug), tail, F.lit(suffix))).drop("number", "base", "skipped", "in use")


def user_report(results: DataFrame, template: str, fields: dict[str, Column], out: str = "entry") -> DataFrame:
    """results with a column rendered from a user's template, in which `{{ name }}` stands for a field, null as ''."""
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    unknown = {p for p in parts[1::2] if p not in fields}
    if unknown:
        raise ValueError(f"the template names fields that are not there: {sorted(unknown)}")
    shown = [F.coalesce(fields[p].cast("string"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)]
    return results.withColumn(out, F.concat(*shown))
