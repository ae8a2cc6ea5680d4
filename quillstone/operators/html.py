"""HTML pages to the library: blocks of text under the path of headings above them, as articles in XML give them.

A tokeniser reads a page from start to end and keeps the stack of open elements. A block ends where an element of its own starts or ends (a paragraph,
a list's item, a table's cell); ``<br>`` is a space. Headings h1 to h6 make the path: one of a level ends those of its level and below. What
isn't text of the page is left out with all inside it: scripts, styles, navigation, footers, forms. End tags that open nothing are ignored; elements
that aren't closed end with what holds them, a paragraph or an item also where the next one starts. A figure is a block of its own: its caption, or
else its image's alternative text.

Defined results: a null or empty page has no blocks. What can't be tokenised further ends the page there. Blocks without a word are left out.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.articles import BLOCKS

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("head script style template noscript nav footer form svg iframe button select".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = {f"h{n}": n for n in range(1, 7)}
PARAGRAPHS = ("p", *HEADINGS)
#: What a start tag ends, if that is open inside the nearest of the elements that hold such things.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


class Page(HTMLParser):
    """The blocks (kind, heading, text) of a page, its title first where it has one."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.held: Counter[str] = Counter()  # how many of each are open, so that depth costs nothing
        self.left_out = 0  # open elements of LEFT_OUT
        self.path: list[tuple[int, str]] = []
        self.text: list[str] = []
        self.blocks: list[tuple[str, str, str]] = []
        self.title: list[str] = []
        self.image = ""
        try:
            self.feed(html)
            self.close()
        except (AssertionError, ValueError):
            pass
        while self.open:
            self._end()
        self._flush("text")

    def _flush(self, kind: str) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.blocks.append((kind, " > ".join(t for _, t in self.path), text))

    def _kind(self) -> str:
        return "figure" if self.held["figure"] else "text"

    def _end(self) -> None:
        """Closes the innermost element."""
        tag = self.open[-1]
        if tag in HEADINGS and not self.left_out:
            level, text = HEADINGS[tag], " ".join("".join(self.text).split())
            self.text = []
            if text:
                self.path = [*[p for p in self.path if p[0] < level], (level, text)]
        elif tag == "figure" and not self.left_out:
            if not self.text and not any(b[0] == "figure" for b in self.blocks[self.figure_at :]):
                self.text = [self.image]
            self._flush("figure")
        elif tag in BLOCK and not self.left_out:
            self._flush(self._kind())
        self.held[self.open.pop()] -= 1
        self.left_out -= tag in LEFT_OUT

    def _end_to(self, at: int) -> None:
        while len(self.open) > at:
            self._end()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            # a block can't be inside a paragraph or a heading: these end here, so one at most is open
            if any(self.held[t] for t in PARAGRAPHS):
                self._end_to(next(k for k in range(len(self.open) - 1, -1, -1) if self.open[k] in PARAGRAPHS))
        if tag in ENDS and any(self.held[t] for t in ENDS[tag][0]):
            same, holders = ENDS[tag]
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k] in same:
                    self._end_to(k)
                    break
                if self.open[k] in holders:
                    break
        if tag == "body" and self.held["head"]:
            self._end_to(self.open.index("head"))
        if tag in BLOCK and not self.left_out:
            self._flush(self._kind())
        if tag in VOID:
            if tag == "img" and self.held["figure"]:
                self.image = dict(attrs).get("alt") or ""
            self.text += [" "] if tag == "br" and not self.left_out else []
            return
        if tag == "figure":
            self.image, self.figure_at = "", len(self.blocks)
        self.open.append(tag)
        self.held[tag] += 1
        self.left_out += tag in LEFT_OUT

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1] == tag:
            self._end()

    def handle_endtag(self, tag: str) -> None:
        if self.held[tag]:
            self._end_to(next(k for k in range(len(self.open) - 1, -1, -1) if self.open[k] == tag))

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1] == "title" and not self.held["svg"]:
            self.title.append(data)
        elif not self.left_out:
            self.text.append(data)


def blocks_of(html: str | None) -> list[tuple[str, str, str]]:
    """(kind, heading, text) in order; the title, if there is one, has the kind title."""
    if not html:
        return []
    page = Page(html)
    title = " ".join("".join(page.title).split())
    return [*([("title", "", title)] if title else []), *page.blocks]


def blocks(pages: DataFrame) -> DataFrame:
    """BLOCKS of pages (doc_key, html), a batch of pages at a time."""

    def rows(batches):
        for b in batches:
            out = [(key, pos, *of) for key, html in zip(b.column(0).to_pylist(), b.column(1), strict=True) for pos, of in enumerate(blocks_of(html.as_py()))]
            columns = zip(*out, strict=True) if out else [[]] * 5
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    return pages.select("doc_key", "html").mapInArrow(rows, BLOCKS)


def papers(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_key, title, has_fulltext, tags) of pages (doc_key, html, tags): the page's title, or else its first heading; text if any block has some."""
    first = F.element_at(F.split(F.min_by("heading", "pos"), " > "), 1)
    of = blocks.groupBy(F.col("doc_key").alias("_key")).agg(F.max(F.when(F.col("kind") == "title", F.col("text"))).alias("title"), first.alias("head"), F.max((F.col("kind") == "text").cast("int")).alias("n"))
    head = F.when(F.col("head") != "", F.col("head"))
    return pages.select("doc_key", "tags").join(of, F.col("doc_key") == F.col("_key"), "left").select("doc_key", F.coalesce("title", head).alias("title"), (F.coalesce("n", F.lit(0)) > 0).alias("has_fulltext"), "tags")
