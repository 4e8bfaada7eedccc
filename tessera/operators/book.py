"""Books: reading order, chapters, numbered outputs, log, progress and summary.

Input: ``spine(book_id, pos, item_id)``, positions from 1, and ``items(book_id,
item_id, name, content, ord)``. Result: one DataFrame per output, all lazy.

The names of files and folders and the words of log lines are fixed values: whoever
reads them expects these.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.html import parsed
from .document import document_text, document_title

NON_CHAPTER_DIR = "non-chapters-files"
#: What a run says of a book of which no item is a chapter.
HINT = (
    f'No item has a title that the chapter rules know: all %d item(s) are in "{NON_CHAPTER_DIR}". If chapters are among them, '
    "add their titles to Config.chapter_titles, or turn chapter detection off."
)
CANCELLED = "Cancelled by user."
NO_TEXT = "No chapter text found. The EPUB may use an unsupported structure."


@dataclass(frozen=True)
class Config:
    keep_reading: bool = False
    single_file: bool = False
    keep_markers: bool = False
    detect_chapters: bool = True
    chapter_titles: Sequence[str] = X.CHAPTER_TITLES

    @property
    def classify(self) -> bool:
        return self.detect_chapters and not self.single_file


def reading_order(spine: DataFrame, items: DataFrame) -> DataFrame:
    """Spine rows with their item; of items with one id the one of the largest ``ord``
    counts (which tells them apart), spine ids without an item are left out, ids the spine
    has twice come twice. Contents are moved once, and no aggregate holds them."""
    last = items.groupBy("book_id", "item_id").agg(F.max("ord").alias("_last"))
    found = items.join(last, ["book_id", "item_id"]).where("ord = _last").select("book_id", "item_id", "name", "content")
    return spine.select("book_id", "pos", "item_id").join(found, ["book_id", "item_id"]).select("book_id", "pos", "item_id", "name", "content")


def chapters(spine: DataFrame, items: DataFrame, cfg: Config = Config()) -> DataFrame:
    """book_id, pos, total, title, text, is_chapter of every item found; is_chapter is
    null where it does not apply (no classification, or no text)."""
    totals = spine.groupBy("book_id").agg(F.count(F.lit(1)).alias("total"))
    found = reading_order(spine, items).select("book_id", "pos", X.stem(F.col("name")).alias("_stem"), parsed(F.col("content"), cfg.keep_reading).alias("_p"))
    rows = found.select("book_id", "pos", document_title(F.col("_p"), F.col("_stem")).alias("title"), document_text(F.col("_p"), cfg.keep_markers).alias("text"))
    hit = F.when(F.col("text") != "", X.is_chapter_title(F.col("title"), cfg.chapter_titles)) if cfg.classify else F.lit(None).cast("boolean")
    return rows.withColumn("is_chapter", hit).join(totals, "book_id").select("book_id", "pos", "total", "title", "text", "is_chapter")


def kept(rows: DataFrame) -> DataFrame:
    """Items with text."""
    return rows.where(F.col("text") != "")


def label(cfg: Config) -> Column:
    return F.when(F.col("is_chapter"), "chapter").otherwise("non-chapter") if cfg.classify else F.lit("item")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds chapter_no: a running count over the chapters of a book."""
    count = F.row_number().over(W.partitionBy("book_id", "is_chapter").orderBy("pos"))
    return kept(rows).withColumn("chapter_no", F.when(F.col("is_chapter"), count))


def outputs(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """book_id, rel_path, text: the files to write. Chapters are numbered among
    themselves; other items keep their position."""
    if cfg.single_file:
        part = F.concat(F.lit("\n\n===== "), X.padded(F.col("pos")), F.lit(" "), F.col("title"), F.lit(" =====\n\n"), F.col("text"), F.lit("\n"))
        parts = kept(rows).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("_parts"))
        name = F.concat(X.stem(F.col("book_id").cast("string")), F.lit("_full_text.txt"))
        return parts.select("book_id", name.alias("rel_path"), F.array_join(F.transform("_parts", lambda p: p["part"]), "").alias("text"))
    own = F.concat(X.padded(F.col("pos")), F.lit("_"), X.safe_filename(F.col("title")), F.lit(".txt"))
    if not cfg.detect_chapters:
        return kept(rows).select("book_id", own.alias("rel_path"), "text")
    chapter = F.concat(F.lit("chapter_"), X.padded(F.col("chapter_no")), F.lit(".txt"))
    path = F.when(F.col("is_chapter"), chapter).otherwise(F.concat(F.lit(f"{NON_CHAPTER_DIR}/"), own))
    return numbered(rows).select("book_id", path.alias("rel_path"), "text")


def log(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """book_id, pos, line: one line per item found."""
    at = F.format_string("  [%03d/%03d] ", "pos", "total")
    named = F.concat(F.lit('"'), F.col("title"), F.lit('"'))
    full = F.concat(at, label(cfg), F.lit(": "), named, F.lit(" ("), F.char_length("text").cast("string"), F.lit(" chars)"))
    return rows.select("book_id", "pos", F.when(F.col("text") == "", F.concat(at, F.lit("(empty, skipped) "), named)).otherwise(full).alias("line"))


def progress(rows: DataFrame) -> DataFrame:
    """book_id, pos, total, title, is_chapter, percent: one event per item found."""
    return rows.select("book_id", "pos", "total", "title", "is_chapter", X.percent(F.col("pos"), F.col("total")).alias("percent"))


def summary(spine: DataFrame, rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """book_id, total_items, chapter_count, non_chapter_count, non_chapter_dir,
    combined_file, cancelled; total_items counts the spine, missing items too."""
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0)).cast("long")
    if cfg.classify:
        made = kept(rows).groupBy("book_id").agg(count(F.col("is_chapter")).alias("c"), count(~F.col("is_chapter")).alias("n"))
    else:
        made = kept(rows).groupBy("book_id").agg(F.count(F.lit(1)).alias("c"), F.lit(0).cast("long").alias("n"))
    totals = spine.groupBy("book_id").agg(F.count(F.lit(1)).alias("total_items"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    combined = F.when(zero("c") > 0, F.concat(X.stem(F.col("book_id").cast("string")), F.lit("_full_text.txt"))) if cfg.single_file else F.lit(None).cast("string")
    return totals.join(made, "book_id", "left").select(
        "book_id", "total_items", zero("c").alias("chapter_count"), zero("n").alias("non_chapter_count"),
        F.when(zero("n") > 0, NON_CHAPTER_DIR).alias("non_chapter_dir"), combined.alias("combined_file"), F.lit(False).alias("cancelled"),
    )


def closing(result: DataFrame, cfg: Config = Config(), out_dir: str = "output") -> DataFrame:
    """book_id, line_no, line: the lines that end a book's log."""
    out = out_dir.rstrip("/")
    if cfg.single_file:
        lines = F.array(F.format_string("Wrote %d chapters to %s/%s", "chapter_count", F.lit(out), "combined_file"))
    elif not cfg.detect_chapters:
        lines = F.array(F.format_string("Wrote %d chapter files to %s", "chapter_count", F.lit(out)))
    else:
        more = F.array(F.format_string("Wrote %d non-chapter file(s) to %s/%s", "non_chapter_count", F.lit(out), "non_chapter_dir"))
        lines = F.concat(F.array(F.format_string("Wrote %d chapter file(s) to %s", "chapter_count", F.lit(out))), F.when(F.col("non_chapter_count") > 0, more).otherwise(F.array().cast("array<string>")))
    none = F.array(F.lit(NO_TEXT))
    some = F.col("chapter_count") + F.col("non_chapter_count") > 0
    stopped = F.array(F.lit(CANCELLED))
    return result.select("book_id", F.posexplode(F.when(F.col("cancelled"), stopped).when(some, lines).otherwise(none)).alias("line_no", "line"))


def log_tag(line: Column) -> Column:
    """How a front end marks a log line; null for a blank one."""
    plain = X.strip(line)
    low = F.lower(plain)
    tag = F.when(low.startswith("wrote") & low.contains("chapter"), "success").when(low.contains("cancelled"), "error").otherwise("text")
    return F.when(plain != "", tag)


def unmatched(result: DataFrame, cfg: Config = Config()) -> DataFrame:
    """book_id, n and hint of the books whose items all went with the non-chapters."""
    hit = (F.col("chapter_count") == 0) & (F.col("non_chapter_count") > 0) & ~F.col("cancelled")
    return result.where(hit & F.lit(cfg.classify)).select("book_id", F.col("non_chapter_count").alias("n"), F.format_string(HINT, "non_chapter_count").alias("hint"))


def cancelled(spine: DataFrame, before: int) -> DataFrame:
    """The summary of books stopped before the item at position ``before``: nothing is
    counted or written. Books with fewer items are not stopped and have no row."""
    totals = spine.groupBy("book_id").agg(F.max("pos").alias("_last")).where(F.col("_last") >= before)
    return totals.select("book_id", F.lit(before - 1).cast("long").alias("total_items"), F.lit(0).cast("long").alias("chapter_count"), F.lit(0).cast("long").alias("non_chapter_count"), F.lit(True).alias("cancelled"))


def state() -> Column:
    """How a run ended, from its summary row."""
    return F.when(F.col("cancelled"), "cancelled").when(F.col("chapter_count") + F.col("non_chapter_count") > 0, "completed").otherwise("failed")
