"""One lenient parse of an HTML document into paragraphs and titles.

The only step in Python: an Arrow-batched UDF. Everything after it is Column work.

Rules. Blocks are p, h1 to h6 and li; a block inside another belongs to the outer one.
Text in no block counts only if a document has none: then the whole text is one
paragraph (its title element with it). Script and style have no text. A p ends at the
next block-level start tag; a heading at the next p, heading or li; an li at the next
li of its list; every open element ends with an enclosing end tag. Unmatched end tags
are ignored. Text between two tags that is ASCII white space only counts as one line
break if it has one, else as one space.

Ruby: rp is dropped, rt texts are the reading, the rest is the base. The result is the
base, or ``base(reading)`` if readings are kept and there is one. Titles have the base.

Bytes are decoded by byte order mark, else by a declared charset, else as UTF-8.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TITLES = ("h1", "h2", "h3", "title")
ENDS_P = BLOCKS | frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form header hr main menu nav ol pre section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style"))
SCHEMA = "blocks array<string>, h1 string, h2 string, h3 string, title string, whole string"

_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_CHARSET = re.compile(rb"""(?:encoding|charset)\s*=\s*["']?([A-Za-z0-9._-]+)""", re.I)


def decode(content: bytes) -> str:
    for mark, name in _MARKS:
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace")
    if found := _CHARSET.search(content[:1024]):
        try:
            return content.decode(codecs.lookup(found[1].decode()).name, "replace")
        except LookupError:
            pass
    return content.decode("utf-8", "replace")


class Parse(HTMLParser):
    def __init__(self, keep_reading: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.keep_reading = keep_reading
        self.open: list[str] = []
        self.count: Counter[str] = Counter()  # of the names in it
        self.inside = 0  # blocks in it
        self.data: list[str] = []  # of the text between two tags
        self.blocks: list[str] = []
        self.block: list[str] | None = None
        self.whole: list[str] = []
        self.titles: dict[str, list[str]] = {}
        self.titled: set[str] = set()  # titles whose first element is open
        self.ruby: tuple[list[str], list[str]] | None = None  # base, reading

    def _put(self, text: str, base: str) -> None:
        """``text`` for paragraphs, ``base`` for titles."""
        self.whole.append(text)
        if self.block is not None:
            self.block.append(text)
        for name in self.titled:
            self.titles[name].append(base)

    def _flush(self) -> None:
        text = "".join(self.data)
        self.data.clear()
        if not text or any(self.count[name] for name in SILENT):
            return
        if not text.strip(" \t\n\r\f\v"):
            text = "\n" if "\n" in text else " "
        if self.ruby is None:
            self._put(text, text)
        elif not self.count["rp"]:
            self.ruby[self.count["rt"] > 0].append(text)

    def _pop(self) -> None:
        name = self.open.pop()
        self.count[name] -= 1
        self.inside -= name in BLOCKS
        if name == "ruby" and not self.count["ruby"] and self.ruby is not None:
            base, reading = ("".join(x) for x in self.ruby)
            self.ruby = None
            self._put(f"{base}({reading})" if self.keep_reading and reading else base, base)
        if name in BLOCKS and not self.inside:
            self.blocks.append("".join(self.block or ()))
            self.block = None
        if name in TITLES and not self.count[name]:
            self.titled.discard(name)

    def _close(self, names: frozenset[str] | set[str], within: frozenset[str] = frozenset()) -> None:
        """End the innermost open element of ``names`` that is not beyond one of ``within``."""
        if not any(self.count[name] for name in names):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] in names:
                while len(self.open) > i:
                    self._pop()
                return
            if self.open[i] in within:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        if tag in ENDS_P:
            self._close({"p"}, frozenset(("table", "td", "th", "object", "button")))
        if tag in HEADINGS or tag in ("p", "li"):
            self._close(HEADINGS, frozenset(("li", "td", "th", "div", "section", "article", "body")))
        if tag == "li":
            self._close({"li"}, frozenset(("ul", "ol", "menu", "dir")))
        if tag in ("rt", "rp"):
            self._close({"rt", "rp"}, frozenset(("ruby",)))
        if tag in VOID:
            return
        if tag in BLOCKS and not self.inside:
            self.block = []
        if tag in TITLES and tag not in self.titles:
            self.titles[tag] = []
            self.titled.add(tag)
        if tag == "ruby" and not self.count["ruby"]:
            self.ruby = ([], [])
        self.open.append(tag)
        self.count[tag] += 1
        self.inside += tag in BLOCKS

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        self._close({tag})

    def handle_data(self, data: str) -> None:
        self.data.append(data)

    def finish(self) -> tuple:
        self.close()
        self._flush()
        while self.open:
            self._pop()
        return (self.blocks, *("".join(self.titles[t]) if t in self.titles else None for t in TITLES), "".join(self.whole))


def parse_document(content: bytes | str | None, keep_reading: bool = False) -> tuple:
    """blocks, h1, h2, h3, title, whole; a title is the text of the first such element."""
    parse = Parse(keep_reading)
    parse.feed(decode(bytes(content)) if not isinstance(content, str | None) else content or "")
    return parse.finish()


def parsed(content: Column, keep_reading: bool = False) -> Column:
    """The parse as one struct column; select it once and use its fields."""

    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_document(x, keep_reading) for x in content], columns=["blocks", *TITLES, "whole"], dtype=object)

    return F.pandas_udf(run, SCHEMA)(content)
