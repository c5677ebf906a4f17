"""Links of web pages, with the texts around them."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame


class _Links(HTMLParser):
    """Collects (href, text, context) of each link; the text of an enclosing table cell is the last resort."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, str]] = []
        self.open: dict | None = None
        self.depth = self.cells = 0
        self.cell: list[str] = []

    def handle_starttag(self, tag, attrs):
        given = {k: (v or "").strip() for k, v in attrs}
        if tag in ("td", "th"):
            self.cells += 1
            if self.cells == 1:
                self.cell = []
        elif tag == "a":
            if not self.depth:
                self.open = {"href": given.get("href", ""), "words": [], "labels": [given.get("title", ""), given.get("aria-label", "")]}
            self.depth += 1
        elif tag == "img":
            for word in (given.get("alt"), given.get("title")):
                self.handle_data(word or "")

    def handle_data(self, data):
        word = data.strip()
        if word and self.open is not None:
            self.open["words"].append(word)
        if word and self.cells:
            self.cell.append(word)

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cells = max(0, self.cells - 1)
            self.cell = self.cell if self.cells else []
        elif tag == "a" and self.depth:
            self.depth -= 1
            if not self.depth and self.open is not None:
                text = " ".join(self.open["words"])
                labels = [x for x in self.open["labels"] if x]
                context = next((x for x in labels if x != text), "") or " ".join(self.cell)
                self.found.append((self.open["href"], (text or next(iter(labels), ""))[:300], context[:300]))
                self.open = None


def links(pages: DataFrame, ident: str = "page_id", html: str = "html") -> DataFrame:
    """(ident, position, href, text, context): the links of each page in order.

    Null pages have no links; broken markup gives the links before it breaks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, out = [], [], [[], [], []]
            for i, page in enumerate(batch.column(1).to_pylist()):
                parser = _Links()
                parser.feed(page or "")
                for position, link in enumerate(parser.found):
                    row.append(i)
                    at.append(position)
                    for x, value in zip(out, link):
                        x.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), *(pa.array(x, pa.string()) for x in out)], [ident, "position", "href", "text", "context"])

    kind = pages.schema[ident].dataType.simpleString()
    return pages.select(ident, html).mapInArrow(run, f"{ident} {kind}, position int, href string, text string, context string")
