"""Titles and paragraphs of pages, by a tokenizer that keeps a stack of open elements."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.sources.runtime import ship_package

#: Elements that are left out with all that is in them (fixed values).
DROPPED = frozenset(["script", "style", "nav", "header", "footer", "aside"])
#: Elements that have no end.
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
MOST_BYTES, LONGER, ENOUGH = 512_000, 35, 150  # of a page that is read; characters of a paragraph, and of a page's text


class Page(HTMLParser):
    """Collects the title and the texts of p elements. An end tag closes all elements opened since its start; one without a start closes nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.dropped = 0  # open elements that are left out
        self.paragraphs: list[list[str]] = []
        self.open: list[list[str]] = []  # of the p elements on the stack
        self.title: list[str] | None = None
        self.titled = False

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self.stack.append(tag)
        if tag in DROPPED:
            self.dropped += 1
        elif tag == "p":
            self.open.append([])
            if not self.dropped:
                self.paragraphs.append(self.open[-1])
        elif tag == "title" and self.title is None:
            self.title = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while True:
            last = self.stack.pop()
            if last in DROPPED:
                self.dropped -= 1
            elif last == "p":
                self.open.pop()
            elif last == "title":
                self.titled = True
            if last == tag:
                return

    def handle_data(self, data):
        if self.title is not None and not self.titled:
            self.title.append(data)
        if not self.dropped:
            for p in self.open:
                p.append(data)


def page_text(html: str | None) -> tuple[str, list[str]]:
    """The title and the paragraphs of more than LONGER characters, without blanks at their ends; of a long page its first MOST_BYTES bytes."""
    if not html:
        return "", []
    if len(html) > MOST_BYTES // 4:
        html = html.encode("utf-8", "surrogatepass")[:MOST_BYTES].decode("utf-8", "ignore")
    page = Page()
    page.feed(html)
    page.close()
    texts = ("".join(p).strip() for p in page.paragraphs)
    return "".join(page.title or ()).strip(), [t for t in texts if len(t) > LONGER]


def page_texts(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id_col, title, paragraphs, full_text) of each row; full_text joins the paragraphs by an empty line and is empty, with the title, where that isn't more than ENOUGH characters."""
    ship_package(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_text(h) for h in batch.column(html_col).to_pylist()]
            whole = ["\n\n".join(p) for _, p in found]
            titles = [t if len(w) > ENOUGH else "" for (t, _), w in zip(found, whole, strict=True)]
            texts = [w if len(w) > ENOUGH else "" for w in whole]
            columns = [batch.column(id_col), pa.array(titles, pa.string()), pa.array([p for _, p in found], pa.list_(pa.string())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "title", "paragraphs", "full_text"])

    return pages.select(id_col, html_col).mapInArrow(run, f"{id_col} {kind}, title string, paragraphs array<string>, full_text string")
