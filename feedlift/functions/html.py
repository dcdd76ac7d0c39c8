"""Text of a product page."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlift.functions.text import as_column, bind

# What is cut, in this order.
_CUT = (
    "(?s)<head.*</head>",
    "<script[^</script][^\n\r\u2028\u2029]*",
    "<svg[^</svg][^\n\r\u2028\u2029]*",
    "<path[^</path][^\n\r\u2028\u2029]*",
    "<iframe[^</iframe][^\n\r\u2028\u2029]*",
    "<a [^</a][^\n\r\u2028\u2029]*",
)
# What is kept, in this order, and the part of it that is its text.
_KEPT = ("<span[^</span][^\n\r\u2028\u2029]*", "<p[^</p][^\n\r\u2028\u2029]*")
_INNER = "(?s)>(.*)<"


def break_lines(html: Column | str) -> Column:
    """A line feed between adjacent tags, for pages written on one line."""
    return F.regexp_replace(as_column(html), "><", ">\n<")


def rule_text(html: Column | str) -> Column:
    """Text of a page by line rules: the head goes, scripts, drawings, frames and links
    go to the end of their line, then span and paragraph lines are kept."""
    text = as_column(html)
    for pattern in _CUT:
        text = F.regexp_replace(text, pattern, "")

    def kept_text(cleaned: Column) -> Column:
        kept = F.concat(*[F.regexp_extract_all(cleaned, F.lit(p), F.lit(0)) for p in _KEPT])
        inner = F.transform(kept, lambda k: F.regexp_extract(k, _INNER, 1))
        return F.array_join(F.filter(inner, lambda t: t != ""), " ")

    return bind(text, kept_text)


def page_text(body: Column | str, content_type: Column | str, *, one_line_pages: bool = False) -> Column:
    """JSON pages pass as they are, other pages by their rule text, missing ones as ''."""
    body, kind = as_column(body), as_column(content_type)
    html = break_lines(body) if one_line_pages else body
    return F.coalesce(
        F.when(kind.startswith("application/json"), body).otherwise(rule_text(html)), F.lit("")
    )


# Elements that have no end tag, and elements whose content is not text (fixed values).
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_NOT_TEXT = frozenset(("script", "style", "template"))


# A class attribute with an entity in its value.
_CODED_CLASS = r"""(?i)class\s*=\s*("[^"]*&|'[^']*&|[^\s"'>]*&)"""


class _DivText(HTMLParser):
    """Collects the text of every div of one class; a nested one counts again."""

    def __init__(self, css_class: str) -> None:
        super().__init__(convert_charrefs=True)
        self._class = css_class
        self._open: list[tuple[str, list[str] | None]] = []
        self.found: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        classes = dict(attrs).get("class") or ""
        sink = None
        if tag == "div" and (self._class in classes.split() or self._class == classes):
            sink = []
            self.found.append(sink)
        self._open.append((tag, sink))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == tag:
                del self._open[i:]
                return

    def handle_data(self, data):
        if self._open and self._open[-1][0] in _NOT_TEXT:
            return
        for _, sink in self._open:
            if sink is not None:
                sink.append(data)


def _div_text(html: str | None, css_class: str) -> str | None:
    if html is None:
        return None
    parser = _DivText(css_class)
    parser.feed(html)
    parser.close()
    return " ".join("".join(t) for t in parser.found)


def div_text(html: Column | str, css_class: str) -> Column:
    """Text of all divs of a class, joined by a space, on one line. Needs a tag tree, so
    it runs in Python over Arrow batches, for pages only that name the class at all."""

    @F.pandas_udf("string")
    def collect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(lambda h: _div_text(h, css_class))

    page = as_column(html)
    # A page may write a sign of the name as an entity, but then in the value of a class.
    named = page.contains(css_class) | page.rlike(_CODED_CLASS)
    found = F.when(named, collect(F.when(named, page)))
    return F.translate(found.when(page.isNotNull(), F.lit("")), "\n\r", " ")
