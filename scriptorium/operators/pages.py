"""Page maps, tables of contents and page plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import ranges, text


def physical_pages(wanted: DataFrame, page_map: DataFrame, doc: str = "ark", page: str = "pno") -> DataFrame:
    """wanted with `ordre`: of the first row of the document's map with that page number, else of its last row."""
    return looked_up(wanted, page_map, {"ordre": F.col(page)}, doc)


def looked_up(wanted: DataFrame, page_map: DataFrame, pages: dict[str, Column], doc: str = "ark") -> DataFrame:
    """wanted with the view of each of some page numbers, by name, as `physical_pages` finds it.

    One aggregate of the map by document, joined once, serves them all; a document's distinct numbers are a map of its own.
    """
    first = page_map.groupBy(doc, "numero").agg(F.min_by("ordre", "pos").alias("hit"), F.max(F.struct("pos", "ordre")).alias("end"))
    numbers = first.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.when(F.col("numero").isNotNull(), F.struct("numero", "hit")))).alias("numbers"), F.max("end").alias("end"))
    found = wanted.join(numbers, doc, "left")
    return found.withColumns({name: F.coalesce(F.try_element_at("numbers", page), F.col("end.ordre")) for name, page in pages.items()}).drop("numbers", "end")


def last_page(page_map: DataFrame, doc: str = "ark") -> DataFrame:
    """Each document's last numbered page (type A), else its first."""
    lettered = F.expr("max_by(ordre, pos) filter (where pagination_type = 'A')")
    return page_map.groupBy(doc).agg(F.coalesce(lettered, F.min_by("ordre", "pos")).alias("last_pno"))


def toc_articles(entries: DataFrame, last: DataFrame, start_page: Column | None, doc: str = "ark", by: tuple[str, ...] = ()) -> DataFrame:
    """Articles that start on a page: split lines, first_page, and last_page before the next entry's start or the document's last page.

    The entries are those of one start page (of each `by`, if there are such columns),
    so all but the last have no pages: their last page is below their first.
    """
    here = (entries if start_page is None else entries.where(F.col("pno") == start_page)).withColumn("first_page", F.col("pno").try_cast("bigint"))
    order = Window.partitionBy(doc, *by).orderBy("first_page", "pos")
    author, title = text.toc_entry(F.col("title"))
    ended = here.withColumn("next", F.lead("first_page").over(order) - 1).join(last, doc, "left")
    return ended.select(doc, *by, "pos", author.alias("author"), title.alias("title"), "first_page", F.coalesce("next", F.col("last_pno").cast("bigint")).alias("last_page"))


def page_list(first: Column, last: Column) -> Column:
    """The pages of a run as an array of strings; empty if the last is below the first."""
    return ranges.span(first, last).cast("array<string>")


def content_slice(page_text: DataFrame, start: Column | int, views: Column | int | None = None) -> DataFrame:
    """Text of `views` pages from `start` on; all the rest by default."""
    begin = F.lit(start) if isinstance(start, int) else start
    rows = page_text.where(F.col("ordre") >= begin)
    return rows if views is None else rows.where(F.col("ordre") < begin + views)


def block_plan(spans: DataFrame, start: str, end: str, size: int = 100) -> DataFrame:
    """Blocks of at most `size` pages that cover start..end: block_no, block_start, block_len."""
    at = F.posexplode(F.when(F.col(end) >= F.col(start), F.sequence(F.col(start), F.col(end), F.lit(size)))).alias("block_no", "block_start")
    return spans.select("*", at).withColumn("block_len", F.least(F.lit(size), F.col(end) - F.col("block_start") + 1))


def limited_end(start: Column, end: Column, fetch_only: int | None) -> Column:
    """Last page to fetch when only so many are wanted."""
    return end if fetch_only is None else F.least(end, start + fetch_only - 1)


def fetch_mode(status: Column) -> Column:
    """Page images where the document itself may not be had (status 451)."""
    return F.when(status == 451, "image").otherwise("pdf")


def merged_pages(partials: DataFrame, doc: str, suppress_cover: Column | bool = False) -> DataFrame:
    """Pages of a document's blocks in order, without the two cover pages of all blocks but the first (of all, if suppressed)."""
    suppress = F.lit(suppress_cover) if isinstance(suppress_cover, bool) else suppress_cover
    kept = partials.where(~((F.col("page_idx") < 2) & ((F.col("block_no") > 0) | suppress)))
    return kept.withColumn("out_page", F.row_number().over(Window.partitionBy(doc).orderBy("block_no", "page_idx")))


def missing_outputs(wanted: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """What has not been written yet."""
    return wanted.join(manifest.select(key).distinct(), key, "left_anti")


def unsuppressed(pages: DataFrame, suppress: list[int], has_cover: bool) -> DataFrame:
    """Pages but those to leave out, whose numbers count from after a cover."""
    shift = 2 if has_cover else 0
    return pages.where(~F.col("page_idx").isin([p - shift for p in suppress]))
