"""From a journal's issues to the article: page numbers, contents, recognised text, scored candidates.

Targets have `target`, `title`, `author`, `pages` (array of strings) and whatever
else is scored; `wanted` pairs each target with the issues to look at, by `target`
and `ark`.  Page maps, contents and page texts are tables by `ark`.  A run of pages
is its first and last page throughout, and an array only where a caller asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import fuzzy, ranges, text
from scriptorium.operators import matching
from scriptorium.operators.pages import looked_up, physical_pages, toc_articles

#: Errors allowed in a title and in an author, and the least likeness of an author that counts.
TITLE_ERRORS, AUTHOR_ERRORS, AUTHOR_RATIO = 2, 5, 80


def all_views(page_map: DataFrame, doc: str = "ark") -> DataFrame:
    """Without logical pages wanted: from the first view to the last, start_p and end_p."""
    return page_map.groupBy(doc).agg(F.lit(1).alias("start_p"), F.count("*").cast("int").alias("end_p"))


def view_span(wanted: DataFrame, page_map: DataFrame, doc: str = "ark", pages: str = "pages") -> DataFrame:
    """wanted with start_p and end_p, the views of the first and last page wanted; null without pages."""
    ends = {"start_p": F.get(pages, F.lit(0)), "end_p": F.try_element_at(pages, F.lit(-1))}
    found = looked_up(wanted, page_map, ends, doc)
    return found.withColumns({name: F.when(page.isNotNull(), F.col(name)) for name, page in ends.items()})


def desired_views(wanted: DataFrame, page_map: DataFrame, key: str = "target", doc: str = "ark", pages: str = "pages") -> DataFrame:
    """(key, doc, views): the view of every page wanted, in order, as an array."""
    each = wanted.select(key, doc, F.posexplode(pages).alias("at", "pno"))
    found = physical_pages(each, page_map, doc)
    views = F.array_sort(F.collect_list(F.struct("at", "ordre")))
    return found.groupBy(key, doc).agg(F.transform(views, lambda v: v["ordre"]).alias("views"))


def issue_facts(meta: DataFrame, description: str = "description") -> DataFrame:
    """Issues with year, volume and number read from the second line of their description."""
    said = ranges.describe(F.coalesce(F.get(description, F.lit(1)), F.lit("")))
    return meta.withColumns(said).withColumnRenamed("year", "publicationdate").withColumnRenamed("year_is_list", "publicationdate_is_list")


def contents_candidates(wanted: DataFrame, entries: DataFrame, page_map: DataFrame, last: DataFrame) -> DataFrame:
    """Entries that start on a target's first page: target, ark, pos, author, title, first_page, last_page and their views.

    Of entries on one page all but the last have no pages, so their views are null.
    """
    here = wanted.select("target", "ark", F.get("pages", F.lit(0)).alias("pno"))
    found = toc_articles(entries.join(here, ["ark", "pno"]), last, None, "ark", by=("target",))
    shown = view_span(found.withColumn("span", F.when(F.col("last_page") >= F.col("first_page"), F.array(F.col("first_page").cast("string"), F.col("last_page").cast("string")))), page_map, pages="span")
    return shown.drop("span").withColumnsRenamed({"start_p": "first_view", "end_p": "last_view"})


def found_in_text(wanted: DataFrame, page_map: DataFrame, page_text: DataFrame) -> DataFrame:
    """The (target, ark) whose title stands on the first page and whose author on the first or the last.

    A title may have 2 errors; of an author, the leftmost place within 5 errors must
    be alike by more than 80.  No first page, no text on it, no title or no author:
    not found.  The author is looked for only where the title is.
    """
    spans = view_span(wanted.select("target", "ark", "title", "author", "pages"), page_map)
    # one table of normal forms for titles and authors, so that Spark deals the texts out once
    texts = page_text.select("ark", F.col("ordre").alias("view"), text.plain(F.col("text")).alias("text")).where(F.length("text") > 0)
    names = spans.select("target", "ark", "start_p", "end_p", text.plain(F.col("title")).alias("title"), text.plain(F.col("author")).alias("author")).where("title IS NOT NULL AND author IS NOT NULL")
    first = names.join(texts.withColumnRenamed("view", "start_p"), ["ark", "start_p"])
    titled = first.where(F.size(fuzzy.near_matches(F.col("title"), F.col("text"), TITLE_ERRORS)) > 0)
    ends = titled.select("target", "ark", "author", F.explode(F.array_distinct(F.array("start_p", "end_p"))).alias("view")).join(texts, ["ark", "view"])
    matched = F.get(fuzzy.near_matches(F.col("author"), F.col("text"), AUTHOR_ERRORS), F.lit(0))["matched"]
    alike = ends.withColumn("matched", matched).where(text.ratio(F.col("matched"), F.col("author")) > AUTHOR_RATIO)
    return alike.select("target", "ark").distinct()


def span_score(pages: Column, first: Column, last: Column) -> Column:
    """Share of the pages wanted that lie in a run of arabic pages; an empty run holds none."""
    inside = lambda p: (p.try_cast("bigint").cast("string") == p) & p.try_cast("bigint").between(first, last)
    return F.when(F.size(pages) > 0, F.size(F.filter(pages, lambda p: F.coalesce(inside(p), F.lit(False)))) / F.size(pages))


def article_scores(candidates: DataFrame) -> dict[str, Column]:
    """Scores by field of candidates that carry the target's fields in a struct `t`."""
    c, t = F.col, F.col("t")
    return {
        "publicationdate": matching.number_score(t["publicationdate"], c("publicationdate"), t["publicationdate_is_list"], c("publicationdate_is_list")),
        "title": matching.text_score(t["title"], c("title")),
        "journaltitle": matching.text_score(t["journaltitle"], c("journaltitle")),
        "pages": F.when(c("via") == "ocr", F.when(F.size(t["pages"]) > 0, 1.0)).otherwise(span_score(t["pages"], c("first_page"), c("last_page"))),
        "author": matching.text_score(t["author"], c("author")),
        "number": matching.number_score(t["number"], c("number"), t["number_is_list"], c("number_is_list")),
        "volume": matching.number_score(t["volume"], c("volume"), t["volume_is_list"], c("volume_is_list")),
    }


def article_candidates(targets: DataFrame, wanted: DataFrame, meta: DataFrame, entries: DataFrame, page_map: DataFrame, last: DataFrame, page_text: DataFrame | None = None, settings: matching.MatchSettings = matching.DEFAULTS) -> DataFrame:
    """The best candidates of each target, scored and ranked.

    wanted: target, ark, issue (the place of an issue in the target's search).  An
    issue's candidates come from its contents; where those have none for the target,
    the target itself is one if the recognised text holds it.  Issues after the first
    good candidate are not considered, and a score below the least confidence ends
    the list.
    """
    pages = wanted.join(targets.select("target", "pages", "title", "author"), "target")
    listed = contents_candidates(pages, entries, page_map, last).withColumn("via", F.lit("toc"))
    if page_text is not None and settings.consider_text:
        left = pages.join(listed.select("target", "ark").distinct(), ["target", "ark"], "left_anti") if settings.consider_toc else pages
        seen = found_in_text(left, page_map, page_text).join(pages, ["target", "ark"])
        spans = view_span(seen, page_map)
        texts = spans.select("target", "ark", F.lit(0).alias("pos"), "author", "title", F.lit(None).cast("bigint").alias("first_page"), F.lit(None).cast("bigint").alias("last_page"), F.col("start_p").alias("first_view"), F.col("end_p").alias("last_view"), F.lit("ocr").alias("via"))
        listed = listed.unionByName(texts) if settings.consider_toc else texts
    known = listed.join(wanted.select("target", "ark", "issue"), ["target", "ark"]).join(issue_facts(meta), "ark")
    whole = known.join(targets.select("target", F.struct(*[F.col(c) for c in targets.columns if c != "target"]).alias("t")), "target")
    scored = whole.withColumn("vals", matching.score_map(article_scores(whole))).withColumn("score", matching.map_mean(F.col("vals")))
    return matching.confident(matching.article_candidates(scored, "target", "issue", "pos", settings=settings), settings=settings)
