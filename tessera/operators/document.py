"""Paragraphs, text and title of HTML documents, from their parse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X


def _clean(value: Column) -> Column:
    return X.strip(X.collapse_newlines(value))


def paragraphs(parse: Column, keep_markers: bool = False) -> Column:
    """Paragraphs in document order, "" for a section break. Without any block, the
    whole text is the one paragraph (if there is any) and is no divider."""
    whole = _clean(parse["whole"])
    blocks = X.break_scenes(F.transform(parse["blocks"], _clean), keep_markers)
    return F.when(F.size(parse["blocks"]) > 0, blocks).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))


def document_text(parse: Column, keep_markers: bool = False) -> Column:
    return X.join_paragraphs(paragraphs(parse, keep_markers))


def document_title(parse: Column, fallback: Column) -> Column:
    """The first of h1, h2, h3 and title whose first element is not blank."""
    return F.coalesce(*(F.nullif(_clean(parse[t]), F.lit("")) for t in ("h1", "h2", "h3", "title")), fallback)
