"""The registered queries of the extraction operators, each with a DuckDB twin.

The driver's tables hold no Japanese text, ruby, dividers or books, so most queries
run on inputs derived from them by the same arithmetic in both engines: conversations
are books (a conversation is a spine, a turn an item), pages are HTML, documents are
texts. Each query reads its whole table.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .functions import text as X
from .functions.html import parsed
from .operators import book, document, sink
from .shipping import ship
from .sources import epub

LONG = "long"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str, html: Column | None = None, keep: bool = False) -> DataFrame:
    pages, cores = read(spark, sf_dir, "pages"), spark.sparkContext.defaultParallelism
    if pages.rdd.getNumPartitions() < cores:  # a few small files: parsing is worth a shuffle
        pages = pages.repartition(cores)
    return pages.select("page_id", "url", parsed(F.col("html") if html is None else html, keep).alias("p"))


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).select("page_id", F.posexplode(document.paragraphs(F.col("p"))).alias("para_pos", "text"))
    return rows.select("page_id", F.col("para_pos").cast(LONG).alias("para_pos"), "text")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", document.document_text(F.col("p")).alias("text"))


def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = document.document_title(F.col("p"), X.stem(F.col("url")))
    return _pages(spark, sf_dir).select("page_id", title.alias("title"), X.is_chapter_title(title).alias("is_chapter"))


def page_no_block_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.regexp_replace("html", r"(?i)<(/?)(?:p|h[1-6]|li)(?=[\s>])", "<$1span")
    rows = _pages(spark, sf_dir, html).select("page_id", document.paragraphs(F.col("p")).alias("ps"))
    return rows.select("page_id", F.size("ps").cast(LONG).alias("n"), F.col("ps")[0].alias("text"))


def _words(text: Column) -> Column:
    """The letters of a text, so that it needs no escapes in HTML."""
    return F.regexp_replace(text, "[^a-zA-Z]+", "x")


def page_nested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _words(F.col("text"))
    html = F.concat(F.lit("<body><ul><li>a"), w, F.lit("<p>b</p></li><li><h2>c</h2>d</li></ul>lost<p>e</p></body>"))
    rows = read(spark, sf_dir, "documents").select("doc_id", parsed(html).alias("p"))
    return rows.select("doc_id", F.array_join(document.paragraphs(F.col("p")), "|").alias("blocks"))


def _ruby(spark: SparkSession, sf_dir: str, keep: bool) -> DataFrame:
    w = _words(F.col("text"))
    html = F.concat(F.lit("<h1>t<ruby>漢<rt>かん</rt></ruby></h1><p><ruby>"), w, F.lit("<rp>(</rp><rt>よ</rt><rp>)</rp>字<rt>じ</rt></ruby>と<ruby>空<rt></rt></ruby></p>"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", parsed(html, keep).alias("p"))
    return rows.select("conv_id", "turn", document.document_text(F.col("p")).alias("text"), document.document_title(F.col("p"), F.lit("")).alias("title"))


def ruby_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruby(spark, sf_dir, False)


def ruby_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruby(spark, sf_dir, True)


def script_style_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<body><script>var a = '<p>no</p>';</script><p>"), _words(F.col("text")), F.lit("<style>p{}</style></p></body>"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", parsed(html).alias("p"))
    return rows.select("conv_id", "turn", document.document_text(F.col("p")).alias("text"))


def collapse_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.collapse_newlines(F.col("text")).alias("text"))


_BLANKS = ("　", " ", "\u0085", " \t", "\x1c \n")


def unicode_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.element_at(F.array(*(F.lit(b) for b in _BLANKS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", X.strip(F.concat(blank, "text", blank)).alias("text"))


_MARKS = ("＊", "※", "ーー", "＊ ＊", "***********", "-~-", "")


def _scenes(spark: SparkSession, sf_dir: str, keep: bool) -> DataFrame:
    mark = F.element_at(F.array(*(F.lit(m) for m in _MARKS)), (F.col("doc_id") % 7 + 1).cast("int"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.array(F.lit("a"), mark, F.lit("b")).alias("ps"))
    return rows.select("doc_id", X.join_paragraphs(X.break_scenes(F.col("ps"), keep)).alias("text"))


def scene_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scenes(spark, sf_dir, False)


def scene_breaks_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scenes(spark, sf_dir, True)


def paragraph_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = F.split(F.regexp_replace("text", r"\. ", "\n\n\n"), "\n", -1)
    return read(spark, sf_dir, "documents").select("doc_id", X.join_paragraphs(F.concat(F.array(F.lit("")), ps, F.array(F.lit(""), F.lit("")))).alias("text"))


_TITLES = ("１", "16", "第一章", "第3話", "Chapter 5", "chapter　12", " 7 ", "CHAPTER 5", "第〇章", "第一章 始まり", "プロローグ", "")


def chapter_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.element_at(F.array(*(F.lit(t) for t in _TITLES)), (F.col("doc_id") % 12 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", title.alias("title"), X.is_chapter_title(title).alias("is_chapter"))


def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("page_id") % 9 == 0, F.lit(" 　 ")).otherwise(F.concat(F.lit(" "), "url", F.lit(' *?"<>|\\ 　 '), "html"))
    return read(spark, sf_dir, "pages").select("page_id", X.safe_filename(name).alias("name"))


def fallback_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(*(F.lit(s) for s in (".xhtml", "/a.b.c", "/.a", "/x/", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", X.stem(F.concat("url", suffix)).alias("title"))


def padded_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.padded(F.col("doc_id") * 3).alias("padded"))


def text_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.char_length("text").cast(LONG).alias("n"))


# Books: the turns of a conversation are its spine and its items; the spine has another
# id for every fifth turn, every third turn has an older item under the same id, every
# seventh (of the sum) has no text.
_NAMES = ("第一章", "12", "Chapter 3", "プロローグ", "note/1", "１")


def _spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") % 5 == 4, "gone").otherwise("i")
    return c.select(F.col("conv_id").alias("book_id"), (F.col("turn") + 1).alias("pos"), F.concat(kind, F.col("turn").cast("string")).alias("item_id"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    key = (F.col("conv_id") + F.col("turn")).cast("int")
    title = F.element_at(F.array(*(F.lit(t) for t in _NAMES)), key % 6 + 1)
    body = F.concat(F.lit("<html><body><h1>"), title, F.lit("</h1><p>"), _words(F.col("text")), F.lit("</p></body></html>"))
    empty = F.lit("<html><body></body></html>")
    now = c.select(
        F.col("conv_id").alias("book_id"), F.concat(F.lit("i"), F.col("turn").cast("string")).alias("item_id"),
        F.concat(F.lit("text/part"), F.col("turn").cast("string"), F.lit(".xhtml")).alias("name"), F.when(key % 7 == 0, empty).otherwise(body).alias("content"), F.lit(1).alias("ord"), "turn",
    )
    old = now.where("turn % 3 = 0").select("book_id", "item_id", F.lit("old.xhtml").alias("name"), F.lit("<p>old</p>").alias("content"), F.lit(0).alias("ord"), "turn")
    return now.unionByName(old).drop("turn")


def _chapters(spark: SparkSession, sf_dir: str, cfg: book.Config) -> DataFrame:
    return book.chapters(_spine(spark, sf_dir), _items(spark, sf_dir), cfg)


SPLIT, FLAT, SINGLE = book.Config(), book.Config(detect_chapters=False), book.Config(single_file=True)


def spine_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.reading_order(_spine(spark, sf_dir), _items(spark, sf_dir)).select("book_id", "pos", "item_id", "name")


def spine_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spine(spark, sf_dir).groupBy("book_id").agg(F.count(F.lit(1)).alias("total_items"))


def empty_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.kept(_chapters(spark, sf_dir, SPLIT)).select("book_id", "pos", "title", "text")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.kept(_chapters(spark, sf_dir, SPLIT)).select("book_id", "pos", book.label(SPLIT).alias("label"))


def labels_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.kept(_chapters(spark, sf_dir, FLAT)).select("book_id", "pos", book.label(FLAT).alias("label"), "is_chapter")


def chapter_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.numbered(_chapters(spark, sf_dir, SPLIT)).where("is_chapter").select("book_id", "pos", F.col("chapter_no").cast(LONG).alias("chapter_no"))


def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.outputs(_chapters(spark, sf_dir, SPLIT), SPLIT)


def flat_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.outputs(_chapters(spark, sf_dir, FLAT), FLAT)


def single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.outputs(_chapters(spark, sf_dir, SINGLE), SINGLE)


def single_beats_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = book.Config(single_file=True, detect_chapters=False)
    return book.outputs(_chapters(spark, sf_dir, cfg), cfg).select("book_id", "rel_path")


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, content: each conversation's spine and items as an EPUB archive. Items of
    one id follow each other by ``ord``; one item in eleven of the manifest is not there."""
    spine = _spine(spark, sf_dir).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("pos", "item_id"))).alias("spine"))
    items = _items(spark, sf_dir).withColumn("turn", F.substring("item_id", 2, 9).cast("int"))
    items = items.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("ord", "turn", "item_id", "name", "content"))).alias("items"))

    def archive(spine: list, items: list) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="in side/book.opf"/></rootfiles></container>')
            manifest = "".join(f'<item id="{x["item_id"]}" href="{x["ord"]}/{x["turn"]}/{x["name"]}" media-type="application/xhtml+xml"/>' for x in items)
            refs = "".join(f'<itemref idref="{x["item_id"]}" linear="{"no" if x["pos"] % 2 else "yes"}"/>' for x in spine)
            z.writestr("in side/book.opf", f'<!DOCTYPE package><package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="css" href="a.css" media-type="text/css"/>{manifest}</manifest><spine>{refs}</spine></package>')
            for x in items:
                if (x["turn"] + x["ord"]) % 11 != 3:
                    z.writestr(f"in side/{x['ord']}/{x['turn']}/{x['name']}", x["content"])
        return out.getvalue()

    return spine.join(items, "book_id").select("book_id", F.udf(archive, "binary", useArrow=False)("spine", "items").alias("content"))


def epub_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epub.read_archives(_archives(spark, sf_dir)).spine


def epub_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = epub.read_archives(_archives(spark, sf_dir)).items
    return rows.select("book_id", "item_id", "name", F.decode("content", "utf-8").alias("content"), "ord")


def epub_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epub.read_archives(_archives(spark, sf_dir)).errors.select("book_id", "item_id", "name")


def _written(spark: SparkSession, sf_dir: str, cfg: book.Config) -> DataFrame:
    """The files that a run writes from archives, read back: rel_path (with the book) and text."""
    found = epub.read_archives(_archives(spark, sf_dir))
    rows = book.outputs(book.chapters(found.spine, found.items, cfg), cfg)
    folder = storage.folder(spark, "files")
    sink.write_files(rows.select(F.concat(F.lit("book "), F.col("book_id").cast("string"), F.lit("/"), "rel_path").alias("rel_path"), "text"), folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", "/(book [0-9]+/.*)", 1).alias("rel_path"), F.decode("content", "utf-8").alias("text"))


def written_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, SPLIT)


def written_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, FLAT)


def written_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, SINGLE)


def _summary(spark: SparkSession, sf_dir: str, cfg: book.Config) -> DataFrame:
    return book.summary(_spine(spark, sf_dir), _chapters(spark, sf_dir, cfg), cfg)


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, SPLIT)


def run_summary_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, FLAT)


def run_summary_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, SINGLE)


def empty_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chapters(spark, sf_dir, SPLIT).withColumn("text", F.when(F.col("book_id") % 2 == 0, "").otherwise(F.col("text")))
    result = book.summary(_spine(spark, sf_dir), rows, SPLIT)
    return book.closing(result, SPLIT).select("book_id", F.col("line_no").cast(LONG).alias("line_no"), "line")


def process_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.log(_chapters(spark, sf_dir, SPLIT), SPLIT)


def log_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chapters(spark, sf_dir, SPLIT)
    ends = book.closing(_summary(spark, sf_dir, SPLIT)).select("book_id", "line")
    lines = book.log(rows.withColumn("title", F.when(F.col("pos") == 2, "cancelled").otherwise(F.col("title"))), SPLIT).select("book_id", "line").unionByName(ends)
    return lines.select("book_id", X.strip(F.col("line")).alias("line"), book.log_tag(F.col("line")).alias("tag"))


def unmatched_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.unmatched(_summary(spark, sf_dir, SPLIT))


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.progress(_chapters(spark, sf_dir, SPLIT))


def cancel_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    stopped = book.cancelled(_spine(spark, sf_dir), 3)
    seen = _chapters(spark, sf_dir, SPLIT).where("pos < 3").groupBy("book_id").agg(F.count(F.lit(1)).alias("events"))
    return stopped.join(seen, "book_id", "left").withColumn("events", F.coalesce("events", F.lit(0).cast(LONG)))


def duration_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", X.duration(F.col("event_id") * 37 + 0.75).alias("elapsed"))


def terminal_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chapters(spark, sf_dir, SPLIT).withColumn("text", F.when(F.col("book_id") % 2 == 0, "").otherwise(F.col("text")))
    result = book.summary(_spine(spark, sf_dir), rows, SPLIT).withColumn("cancelled", F.col("book_id") % 5 == 0)
    return result.select("book_id", book.state().alias("state"))


_QUERIES = (
    page_blocks, page_text, page_title, page_no_block_fallback, page_nested_blocks, ruby_strip, ruby_keep, script_style_dropped, collapse_newlines, unicode_strip,
    scene_breaks, scene_breaks_kept, paragraph_join, chapter_predicate, safe_filename, fallback_title, padded_index, text_length, spine_join, spine_totals, empty_filter,
    labels, labels_flat, chapter_numbering, output_paths, flat_paths, single_file, single_beats_flat, run_summary, run_summary_flat, run_summary_single, empty_book,
    epub_spine, epub_items, epub_errors, written_chapters, written_flat, written_single, process_log, log_tags, unmatched_books, progress_events, cancel_prefix, duration_format, terminal_state,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}
