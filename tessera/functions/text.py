"""Text normalisation as Column functions; nothing here leaves the JVM.

``WS`` is the set of code points that Unicode-aware stripping removes. Java's ``\\s``
and ``trim`` know fewer of them, so patterns spell it out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, dividers and chapter titles.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
DIVIDER = r"[＊*・○●◎□■▽△◇☆★†‡~〜\-－ー]{1,10}"
CHAPTER_TITLES = (
    r"[0-9０-９]+",
    r"第[0-9０-９一二三四五六七八九十百千]+[章話部編]",
    rf"[Cc]hapter{WS}*[0-9０-９]+",
)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def collapse_newlines(text: Column) -> Column:
    """Line breaks and the blanks around them vanish; no space takes their place."""
    return F.regexp_replace(text, r"[ \t]*[\r\n]+[ \t]*", "")


def is_divider(paragraph: Column) -> Column:
    return paragraph.rlike(rf"\A{DIVIDER}\z")


def break_scenes(paragraphs: Column, keep_markers: bool = False) -> Column:
    """Paragraphs that are only a divider become empty: section breaks."""
    if keep_markers:
        return paragraphs
    return F.transform(paragraphs, lambda p: F.when(is_divider(p), "").otherwise(p))


def join_paragraphs(paragraphs: Column) -> Column:
    """One line break between paragraphs, two for any run of empty ones, none at the
    ends. Paragraphs hold no line breaks themselves."""
    joined = F.regexp_replace(F.array_join(paragraphs, "\n"), r"\A\n+|\n+\z", "")
    return F.regexp_replace(joined, r"\n{2,}", "\n\n")


def is_chapter_title(title: Column, patterns: Sequence[str] = CHAPTER_TITLES) -> Column:
    """Whether the stripped title matches one of ``patterns`` as a whole."""
    return F.coalesce(strip(title).rlike(rf"\A(?:{'|'.join(patterns)})\z"), F.lit(False)) if patterns else F.lit(False)


def safe_filename(name: Column, most: int = 60) -> Column:
    """A name without the characters that file systems refuse."""
    plain = F.regexp_replace(strip(F.regexp_replace(name, r'[\\/:*?"<>|]', "_")), WS + "+", " ")
    return F.substring(F.coalesce(F.nullif(plain, F.lit("")), F.lit("untitled")), 1, most)


def padded(index: Column) -> Column:
    """At least three digits; longer numbers stay whole."""
    return F.format_string("%03d", index)


def stem(path: Column) -> Column:
    """The last part of a path without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*\z", 1), r"(?<=.)\.[^.]+\z", "")


def duration(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds."""
    s = F.floor(seconds).cast("long")
    part = lambda by, most=None: F.call_function("div", s, F.lit(by).cast("long")) % most if most else F.call_function("div", s, F.lit(by).cast("long"))
    return F.format_string("%02d:%02d:%02d", part(3600), part(60, 60), s % 60)


def percent(position: Column, total: Column) -> Column:
    """Whole percent of a double division; 0 without a total."""
    return F.when(total > 0, F.floor(position.cast("double") / total * 100)).otherwise(0).cast("long")
