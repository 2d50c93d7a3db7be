"""What has to be fetched of each document, in one plan: pieces, how to ask for them, and where their pages go.

Nothing is fetched here.  A plan's rows say what a fetcher asks for, and what to do with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators import articles, pages

#: Pages of its own that an archive puts before the document's, in every piece.
COVER = 2


@dataclass(frozen=True)
class DownloadSettings:
    """How documents are fetched: pages to a piece, the most pages of a document, tries, and what is left out."""

    block_size: int = 100
    fetch_only: int | None = None
    suppress_cover_page: bool = False
    skip_existing: bool = True
    trials: int = 7

    def __post_init__(self):
        if self.block_size < 1 or self.trials < 1 or (self.fetch_only is not None and self.fetch_only < 1):
            raise ValueError("block_size, trials and fetch_only are one or more")

    def waits(self) -> list[int]:
        """Seconds after each try that failed."""
        return [2 ** (k + 1) for k in range(self.trials)]


def plan(wanted: DataFrame, page_map: DataFrame, statuses: DataFrame, done: DataFrame | None = None, settings: DownloadSettings = DownloadSettings(), key: str = "target", doc: str = "ark") -> DataFrame:
    """key, doc, mode, block_no, first_view, views, dropped, out_page and waits of every piece to fetch.

    wanted: key, doc and `pages`, an array of logical pages; null or empty for the whole document.
    statuses: doc and status, as the archive answers for the document; 451 has pages
    fetched as images, one by one.  done: keys that are written already, left out if settings say so.

    dropped says how many pages of a piece are not the document's: the archive's own, of every
    piece but the first, and of that, too, if they are suppressed; images have none.  out_page is the
    place, from 1, of the piece's first page that stays.  A document without a page map has no rows;
    nor has one whose last view lies before its first.
    """
    left = pages.missing_outputs(wanted, done, key) if done is not None and settings.skip_existing else wanted
    some = F.coalesce(F.size("pages") > 0, F.lit(False))
    spans = articles.view_span(left.select(key, doc, "pages"), page_map, doc)
    whole = articles.all_views(page_map, doc).select(doc, F.col("start_p").alias("first"), F.col("end_p").alias("last"))
    held = spans.join(whole, doc).select(key, doc, F.when(some, F.col("start_p")).otherwise(F.col("first")).alias("start"), F.when(some, F.col("end_p")).otherwise(F.col("last")).alias("end"))
    asked = held.join(statuses.select(doc, "status"), doc, "left").withColumn("mode", pages.fetch_mode(F.col("status"))).withColumn("end", pages.limited_end(F.col("start"), F.col("end"), settings.fetch_only))
    size = F.when(F.col("mode") == "image", 1).otherwise(settings.block_size)
    at = F.posexplode(F.when(F.col("end") >= F.col("start"), F.sequence("start", "end", size.cast("int")))).alias("block_no", "first_view")
    pieces = asked.withColumn("size", size).select(key, doc, "mode", "end", "size", at).withColumn("views", F.least("size", F.col("end") - F.col("first_view") + 1))
    own = (F.col("mode") == "pdf") & ((F.col("block_no") > 0) | F.lit(settings.suppress_cover_page))
    cover = F.when((F.col("mode") == "pdf") & ~F.lit(settings.suppress_cover_page), COVER).otherwise(0)
    before = F.sum("views").over(Window.partitionBy(key, doc).orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1))
    out_page = F.when(F.col("block_no") == 0, 1).otherwise(F.coalesce(before, F.lit(0)) + cover + 1)
    return pieces.select(key, doc, "mode", "block_no", "first_view", "views", F.when(own, COVER).otherwise(0).alias("dropped"), out_page.cast("int").alias("out_page"), F.array(*map(F.lit, settings.waits())).alias("waits"))
