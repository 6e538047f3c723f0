"""Narrative text of HTML: blocks of visible text, without scripts, tables, hidden parts and noise."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.narrative import noise

DROPPED = {"script", "style", "noscript", "table"}
#: Tags whose text is a block; a div only if no block stands right below it.
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "div"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: An opening tag ends open tags of these kinds, as browsers read it.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "div": {"p"}, "ul": {"p"}, "ol": {"p"}, "table": {"p"}} | {f"h{n}": {"p"} for n in range(1, 7)}


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []  # tag, place of its block or None, whether a block stands right below
        self.found: list[list[str] | None] = []
        self.hidden: list[str] = []  # open tags from the first hidden one on

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            return
        style = dict(attrs).get("style") or ""
        if self.hidden or tag in DROPPED or "display:none" in style or "visibility:hidden" in style:
            self.hidden.append(tag)
            return
        while self.open and self.open[-1][0] in ENDS.get(tag, ()):
            self.end(len(self.open) - 1)
        if tag.startswith("ix:") or tag in ("nonfraction", "nonnumeric", "fraction", "continuation"):
            return  # inline facts are no elements of their own
        place = None
        if tag in BLOCKS:
            if self.open:
                self.open[-1][2] = True
            place = len(self.found)
            self.found.append([])
        self.open.append([tag, place, False])

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
        elif not self.hidden:
            for k in reversed(range(len(self.open))):
                if self.open[k][0] == tag:
                    while len(self.open) > k:
                        self.end(len(self.open) - 1)
                    break

    def end(self, k: int) -> None:
        tag, place, parent = self.open.pop(k)
        if place is not None and tag == "div" and parent:
            self.found[place] = None

    def handle_data(self, data: str) -> None:
        if not self.hidden and data.strip():
            for _, place, _ in self.open:
                if place is not None:
                    self.found[place].append(data.strip())

    def texts(self) -> list[str]:
        self.close()
        while self.open:
            self.end(len(self.open) - 1)
        joined = [" ".join(" ".join(own).replace("\xa0", " ").split()) for own in self.found if own]
        return [t for t in joined if len(t) > 2]


def blocks(html: str | None) -> list[str]:
    """The texts of the blocks in the order in which they begin."""
    parser = _Blocks()
    parser.feed(html or "")
    return parser.texts()


def narrative_texts(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key and narrative text of every page; blocks that are noise (page heads, part markers) are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [blocks(x) for x in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.list_(pa.string()))], [key, "_blocks"])

    rows = pages.select(F.col(key).cast("long"), F.col(html).cast("string").alias("_html")).mapInArrow(run, f"{key} long, _blocks array<string>")
    return rows.select(key, F.array_join(F.filter("_blocks", lambda b: ~noise(b)), "\n\n").alias("text"))
