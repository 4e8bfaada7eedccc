"""Extraction of books, from archives to files, log, progress and summary."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import book
from .operators.sink import make_folder, write_files
from .shipping import ship
from .sources.epub import Limits, read_books
from .storage import table

#: Items of a book that are parsed before the first and between later calls of progress.
FIRST, MOST = 8, 64


@dataclass(frozen=True)
class Extraction:
    """The results of a run, keyed by book_id."""

    outputs: DataFrame
    log: DataFrame
    progress: DataFrame
    summary: DataFrame
    #: book_id, item_id (null: the whole book), name and error of what was not read; None if the tables were given.
    errors: DataFrame | None = None


# Fixed names: callers read these fields.
@dataclass(frozen=True)
class ExtractResult:
    out_dir: Path
    total_items: int
    chapter_count: int
    non_chapter_count: int
    non_chapter_dir: Path | None = None
    combined_file: Path | None = None
    cancelled: bool = False


def default_output_dir(epub_path: str) -> Path:
    return Path(epub_path).parent / "output"


def _results(spine: DataFrame, rows: DataFrame, cfg: book.Config) -> Extraction:
    return Extraction(book.outputs(rows, cfg), book.log(rows, cfg), book.progress(rows), book.summary(spine, rows, cfg))


def extract(spine: DataFrame, items: DataFrame, cfg: book.Config = book.Config()) -> Extraction:
    """The lazy results for tables of books; each parses what it needs."""
    ship(spine.sparkSession)
    return _results(spine, book.chapters(spine, items, cfg), cfg)


def extract_paths(spark: SparkSession, paths: str | Sequence[str], cfg: book.Config = book.Config(), limits: Limits = Limits()) -> Extraction:
    """Many books: archives are unpacked once and documents parsed once, into shared
    tables; the results read these."""
    found = read_books(spark, paths, limits=limits)
    rows = table(book.chapters(found.spine, found.items, cfg), "chapters")
    return replace(_results(found.spine, rows, cfg), errors=found.errors)


def extract_epub(
    spark: SparkSession,
    epub_path: str,
    out_dir: str | None = None,
    cfg: book.Config = book.Config(),
    log: Callable[[str], None] = print,
    on_progress: Callable[[int, int, str, bool | None], None] | None = None,
    is_cancelled: Callable[[], bool] | None = None,
    limits: Limits = Limits(),
) -> ExtractResult:
    """One book to text files below ``out_dir`` (by default, a folder beside the book).

    Items are parsed some at a time, in reading order, and reported as soon as they are.
    ``is_cancelled`` is asked before each; once it says yes, later items are not parsed
    and nothing is written. An item that cannot be read is named in the log and left out."""
    out = out_dir or str(default_output_dir(epub_path))
    make_folder(out)
    found = read_books(spark, epub_path, limits=limits)
    errors = found.errors.collect()  # of one book
    if broken := [e["error"] for e in errors if e["item_id"] is None and e["name"] is None]:
        raise ValueError(broken[0])
    for e in errors:
        log(f"  (unreadable, left out) {e['name']}: {e['error']}")
    spine = found.spine.withColumn("book_id", F.lit(epub_path))
    rows = book.chapters(spine, found.items.withColumn("book_id", F.lit(epub_path)), cfg)
    total, parts, first, size = spine.count(), [], 1, FIRST
    seen: dict[int, tuple] = {}

    for pos in range(1, total + 1):
        if is_cancelled and is_cancelled():
            log(book.CANCELLED)
            return ExtractResult(Path(out), pos - 1, 0, 0, cancelled=True)
        if pos == first:
            last = min(first + size - 1, total)
            parts.append(table(rows.where(F.col("pos").between(first, last)), "chapters"))
            lines = book.log(parts[-1], cfg).join(book.progress(parts[-1]).select("pos", "title", "is_chapter"), "pos")
            seen = {r["pos"]: (r["line"], r["title"], r["is_chapter"]) for r in lines.collect()}  # at most ``MOST``
            first, size = last + 1, min(2 * size, MOST)
        if pos in seen:
            line, title, is_chapter = seen[pos]
            log(line)
            if on_progress:
                on_progress(pos, total, title, is_chapter)
    if not parts:
        log(book.NO_TEXT)
        return ExtractResult(Path(out), 0, 0, 0)
    rows = reduce(DataFrame.unionByName, parts)
    result = book.summary(spine, rows, cfg)
    row = result.first()
    write_files(book.outputs(rows, cfg), out)
    for r in book.closing(result, cfg, out).orderBy("line_no").collect():
        log(r["line"])
    name = lambda c: Path(out) / row[c] if row[c] else None
    return ExtractResult(Path(out), row["total_items"], row["chapter_count"], row["non_chapter_count"], name("non_chapter_dir"), name("combined_file"))


__all__ = ["ExtractResult", "Extraction", "extract", "extract_epub", "extract_paths"]
