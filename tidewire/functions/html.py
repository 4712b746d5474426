"""Text of HTML pages by the standard parser, as an Arrow-batched operator."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import wordlists as L

#: Tags that never hold anything, so they need no end tag.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OUTPUT = "url string, title string, paragraphs array<string>"


class Paragraphs(HTMLParser):
    """The title and the paragraph texts of a page outside tags and classes that aren't part of an article."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.paragraphs = "", []
        self._open: list[tuple[str, bool]] = []
        self._dropped = 0
        self._text: list[str] | None = None
        self._in_title = False

    def _drops(self, tag: str, attributes: list[tuple[str, str | None]]) -> bool:
        classes = set((dict(attributes).get("class") or "").split())
        family = classes & set(L.HTML_CLASSES) and tag in ("div", "section", "span") or tag == "div" and classes & set(L.HTML_DIV_CLASSES)
        return bool(tag in L.HTML_TAGS or tag in L.HTML_TEXTLESS or family)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            return
        drops = self._drops(tag, attrs)
        self._open.append((tag, drops))
        self._dropped += drops
        if tag == "title" and not self.title:
            self._in_title = True
        if tag == "p" and not self._dropped:
            self._close()
            self._text = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self._in_title = False
        if tag == "p":
            self._close()
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                self._dropped -= sum(d for _, d in self._open[k:])
                del self._open[k:]
                return

    def handle_data(self, data: str) -> None:
        if self._in_title:
            self.title += data
        elif self._text is not None and not self._dropped and data.strip():
            self._text.append(data.strip())

    def _close(self) -> None:
        if self._text:
            self.paragraphs.append(" ".join(self._text))
        self._text = None

    def close(self) -> None:
        super().close()
        self._close()


def extract(html: str | None) -> tuple[str, list[str]]:
    """Title and paragraphs; 'No Title Found' where there is none, no paragraphs for null and broken pages."""
    page = Paragraphs()
    page.feed(html or "")
    page.close()
    return page.title.strip() or "No Title Found", page.paragraphs


def readable(fetched: DataFrame) -> DataFrame:
    """Answers (status, content_type, ...) that hold a page: a status below 400 and an HTML type, in any case.

    A null status or type is no page. Two native predicates, which a scan of stored answers pushes down in part.
    """
    return fetched.filter((F.col("status") < 400) & F.lower("content_type").contains("text/html"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(url, title, paragraphs) of pages (url, html), where they are read; every paragraph counts, the first one too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(x) for x in batch.column("html").to_pylist()]
            columns = [batch.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([p for _, p in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["url", "title", "paragraphs"])

    return pages.select("url", "html").mapInArrow(run, OUTPUT)
