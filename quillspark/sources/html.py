"""Layout of web pages: blocks of text with size, weight and place, by a scanner of tags.

A block begins and ends with tags that start a line of their own; a ``br`` ends a line in it. Bold is told by the tags that are open,
which a new block closes where the page forgot to, centring by the block's own tag. Scripts, styles and comments hold no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = "struct<text:string,font_size:double,is_bold:boolean,is_centered:boolean,position:struct<x:double,y:double>>"
LAYOUT = f"struct<headings:array<struct<level:int,text:string>>,blocks:array<{BLOCK}>,base_font_size:double>"
#: Pages of a batch that are scanned before their blocks leave.
AT_A_TIME = 64
#: Size of plain text, and of headings by level as browsers show them.
BASE = 10.0
SIZES = {1: 20.0, 2: 15.0, 3: 11.7, 4: 10.0, 5: 8.3, 6: 6.7}
# Tags that begin a block, that hold no text, and that make it bold or stand in the middle.
BLOCKS = frozenset("address article aside blockquote body center dd div dl dt fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td th thead tr ul".split())
SILENT, BOLD = frozenset(("script", "style", "template", "title", "noscript")), frozenset(("b", "strong", "th"))


class _Scanner(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.headings: list[dict] = []
        self.silent, self.bold, self.level, self.centred = "", 0, 0, False
        self.parts: list[tuple[str, bool]] = []

    def _closed(self) -> None:
        """Ends the block at hand; what has no text is none."""
        text = "".join(t for t, _ in self.parts)
        text = "\n".join(filter(None, (" ".join(line.split()) for line in text.split("\n"))))
        if text:
            bold = self.level > 0 or all(b for t, b in self.parts if t.strip())
            self.blocks.append({"text": text, "font_size": SIZES.get(self.level, BASE), "is_bold": bold, "is_centered": self.centred, "position": {"x": 0.0, "y": float(len(self.blocks))}})
            if self.level:
                self.headings.append({"level": self.level, "text": text})
        self.parts, self.bold = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent:
            return
        if tag in SILENT:
            self.silent = tag
        elif tag == "br":
            self.parts.append(("\n", True))
        elif tag in BLOCKS:
            self._closed()
            self.level = int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else 0
            known = {k: (v or "").replace(" ", "").lower() for k, v in attrs}
            self.centred = tag == "center" or known.get("align") == "center" or "text-align:center" in known.get("style", "")
            self.bold = int(tag == "th")
        elif tag in BOLD:
            self.bold += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br" or tag in BLOCKS:  # others are empty
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            self.silent = "" if tag == self.silent else self.silent
        elif tag in BLOCKS:
            self._closed()
            self.level, self.centred = 0, False
        elif tag in BOLD:
            self.bold = max(self.bold - 1, 0)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append((data.replace("\n", " "), self.bold > 0))


def scan(html: str | None) -> dict:
    """text (a line for each line of each block) and layout of a page; a page that is null has neither."""
    scanner = _Scanner()
    scanner.feed(html or "")
    scanner.close()
    scanner._closed()
    return {"text": "\n".join(b["text"] for b in scanner.blocks), "layout": {"headings": scanner.headings, "blocks": scanner.blocks, "base_font_size": BASE}}


def layout_of(html: Column) -> Column:
    """A struct of text and layout. Of a batch ``AT_A_TIME`` pages have their blocks in memory at once."""

    @F.pandas_udf(f"text string, layout {LAYOUT}")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            yield from scanned(pages)

    return of(html)


def scanned(pages: pd.Series) -> Iterator[pd.DataFrame]:
    for at in range(0, len(pages), AT_A_TIME):
        yield pd.DataFrame([scan(p) for p in pages[at : at + AT_A_TIME]], columns=["text", "layout"])
