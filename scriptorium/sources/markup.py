"""Tables of contents, page text and text boxes from markup that need not be well formed."""

from __future__ import annotations

from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOC = T.ArrayType(T.StructType([T.StructField("pno", T.StringType()), T.StructField("title", T.StringType())]))
_POINT = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])
BOX = T.StructType([T.StructField("upper", _POINT), T.StructField("lower", _POINT), T.StructField("total_width", T.IntegerType()), T.StructField("total_height", T.IntegerType())])
_VOID = {"br", "hr", "img", "input", "link", "meta", "lb", "pb"}


class Node:
    """An element: name, attributes, and children that are nodes or strings."""

    def __init__(self, name: str, attrs: dict[str, str | None], parent: Node | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def all(self, *names: str):
        """Descendants of these names, in document order."""
        for child in self.children:
            if isinstance(child, Node):
                if child.name in names:
                    yield child
                yield from child.all(*names)

    def first(self, *names: str) -> Node | None:
        return next(self.all(*names), None)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(markup: str) -> Node:
    """A tree of whatever tags there are; stray ends are passed over."""
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    return builder.root


@dataclass(frozen=True)
class TocLayout:
    """What holds an entry, its title and its page: element names, or `name@attribute` for the page."""

    row: str = "row"
    item: str = "item"
    cell: str = "seg"
    page: str = "xref"


#: Lists of links in web pages.
PageLinks = TocLayout(row="", item="li", cell="a", page="a@href")


def toc_entries(markup: str, layout: TocLayout = TocLayout()) -> list[dict]:
    """(page number, title): of rows with both, if there are rows; else of items with a title."""
    root = tree(markup)
    out = []
    rows = list(root.all(layout.row)) if layout.row else []
    name, _, attribute = layout.page.partition("@")
    for node in rows or root.all(layout.item):
        seg, ref = node.first(layout.cell), node.first(name)
        title = seg.text().strip() if seg else ""
        pno = ((ref.attrs.get(attribute) or "") if attribute else ref.text()).strip() if ref else ""
        if (rows and title and pno) or (not rows and seg is not None and ref is not None):
            out.append({"pno": pno, "title": title})
    return out


def text_after_rule(markup: str) -> str:
    """Text of what follows the first rule beside it, without rules, joined by spaces."""
    rule = tree(markup).first("hr")
    if rule is None:
        return ""
    beside = rule.parent.children
    after = beside[next(i for i, c in enumerate(beside) if c is rule) + 1 :]
    return " ".join(c if isinstance(c, str) else c.text() for c in after if isinstance(c, str) or c.name != "hr")


def text_box(markup: str) -> dict | None:
    """The print space of a page of character recognition, and the page's size."""
    root = tree(markup)
    space, page = root.first("printspace"), root.first("page")
    try:
        x, y, w, h = (int(float(space.attrs[k])) for k in ("hpos", "vpos", "width", "height"))
        total = [int(float(page.attrs[k])) for k in ("width", "height")]
    except (AttributeError, KeyError, TypeError, ValueError):
        return None
    return {"upper": {"x": x, "y": y}, "lower": {"x": x + w, "y": y + h}, "total_width": total[0], "total_height": total[1]}


def parse_toc(markup: Column, layout: TocLayout = TocLayout()) -> Column:
    """Entries of a table of contents as an array; empty for null."""

    @F.pandas_udf(TOC)
    def read(text: pd.Series) -> pd.Series:
        return text.map(lambda m: toc_entries(m, layout) if m else [])

    return read(markup)


@F.pandas_udf(T.StringType())
def page_text(markup: pd.Series) -> pd.Series:
    return markup.map(text_after_rule, na_action="ignore")


def toc_table(pages: DataFrame, markup: str, keys: list[str], layout: TocLayout = TocLayout()) -> DataFrame:
    """One row an entry: keys, pos, pno, title."""
    return pages.select(*keys, F.posexplode(parse_toc(F.col(markup), layout)).alias("pos", "e")).select(*keys, "pos", "e.pno", "e.title")


def ocr_box(markup: Column) -> Column:
    """The text box of a page of character recognition, by the lenient reader; null for what has none."""

    @F.pandas_udf(BOX)
    def lenient(text: pd.Series) -> pd.DataFrame:
        none = {"upper": None, "lower": None, "total_width": None, "total_height": None}
        return pd.DataFrame([(text_box(t) if t else None) or none for t in text], columns=list(none))

    return lenient(markup)
