"""Books: a small one with every kind of item, and the cases it leaves open."""

import io
import os
import time
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera import extract as E
from tessera.extract import extract, extract_epub, extract_paths
from tessera.operators import book
from tessera.operators.sink import safe_target, write_files
from tessera.run import Run
from tessera.sources.epub import Limits, read_archive, read_archives, read_books

#: A cover, a note, three chapters (one with a spacer, one with a divider), a colophon and an empty page.
ITEMS = [
    ("front", "p-000.xhtml", "<p>灯台の夜</p>"),
    ("words", "p-001.xhtml", "<h1>はじめに</h1><p>この話は島の話です。</p>"),
    ("one", "p-002.xhtml", "<h1>１</h1><p>朝、舟が出た。</p><p><br/></p><p>風はなかった。</p>"),
    ("two", "p-003.xhtml", "<h1>２</h1><p>昼、鳥が来た。</p>"),
    ("three", "p-004.xhtml", "<h1>３</h1><p>＊</p><p>夜、灯がともる。</p>"),
    ("end", "p-005.xhtml", "<p>島の印刷所にて。</p>"),
    ("blank", "blank.xhtml", ""),
]
TEXTS = {
    "non-chapters-files/001_p-000.txt": "灯台の夜",
    "non-chapters-files/002_はじめに.txt": "はじめに\nこの話は島の話です。",
    "chapter_001.txt": "１\n朝、舟が出た。\n\n風はなかった。",
    "chapter_002.txt": "２\n昼、鳥が来た。",
    "chapter_003.txt": "３\n\n夜、灯がともる。",
    "non-chapters-files/006_p-005.txt": "島の印刷所にて。",
}
FLAT = ["001_p-000.txt", "002_はじめに.txt", "003_１.txt", "004_２.txt", "005_３.txt", "006_p-005.txt"]


def page(body):
    return f"<html><body>{body}</body></html>".encode()


def archive(items=ITEMS, spine=None, before="", left_out=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        manifest = "".join(f'<item id="{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n, _ in items) + '<item id="css" href="a.css" media-type="text/css"/>'
        refs = "".join(f'<itemref idref="{i}"/>' for i in spine or [i for i, _, _ in items])
        z.writestr("OEBPS/content.opf", before + f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{manifest}</manifest><spine>{refs}</spine></package>')
        for i, n, body in items:
            if i not in left_out:
                z.writestr(f"OEBPS/{n}", page(body))
    return out.getvalue()


@pytest.fixture(scope="module")
def tables(spark):
    spine = spark.createDataFrame([("b", n, i) for n, (i, _, _) in enumerate(ITEMS, 1)], "book_id string, pos long, item_id string")
    items = spark.createDataFrame([("b", i, n, page(c), k) for k, (i, n, c) in enumerate(ITEMS)], "book_id string, item_id string, name string, content binary, ord long")
    return spine, items


@pytest.fixture
def epub(tmp_path):
    path = tmp_path / "novel.epub"
    path.write_bytes(archive())
    return path


def test_chapters_and_others(tables):
    found = extract(*tables)
    assert {r["rel_path"]: r["text"] for r in found.outputs.collect()} == TEXTS
    assert found.summary.first().asDict() == {"book_id": "b", "total_items": 7, "chapter_count": 3, "non_chapter_count": 3, "non_chapter_dir": "non-chapters-files", "combined_file": None, "cancelled": False}


def test_log_and_progress(tables):
    found = extract(*tables)
    lines = [r["line"] for r in found.log.orderBy("pos").collect()]
    assert lines[0] == '  [001/007] non-chapter: "p-000" (4 chars)'
    assert lines[2] == '  [003/007] chapter: "１" (18 chars)'
    assert lines[6] == '  [007/007] (empty, skipped) "blank"'
    events = [(r["pos"], r["is_chapter"], r["percent"]) for r in found.progress.orderBy("pos").collect()]
    assert events == [(1, False, 14), (2, False, 28), (3, True, 42), (4, True, 57), (5, True, 71), (6, False, 85), (7, None, 100)]


def test_flat(tables):
    cfg = book.Config(detect_chapters=False)
    found = extract(*tables, cfg)
    assert sorted(r["rel_path"] for r in found.outputs.collect()) == FLAT
    row = found.summary.first()
    assert (row["chapter_count"], row["non_chapter_count"], row["non_chapter_dir"]) == (6, 0, None)
    assert found.log.orderBy("pos").first()["line"].startswith("  [001/007] item: ")


def test_single_file_beats_flat(tables):
    found = extract(*tables, book.Config(single_file=True, detect_chapters=False))
    (row,) = found.outputs.collect()
    assert row["rel_path"] == "b_full_text.txt"
    assert row["text"].startswith("\n\n===== 001 p-000 =====\n\n灯台の夜\n\n\n===== 002 ")
    assert found.summary.first()["combined_file"] == "b_full_text.txt"


def test_missing_duplicate_and_repeated_ids(spark, tables):
    spine = spark.createDataFrame([("b", 1, "gone"), ("b", 2, "x"), ("b", 3, "x")], "book_id string, pos long, item_id string")
    items = spark.createDataFrame([("b", "x", "old.xhtml", page("<p>old</p>"), 0), ("b", "x", "new.xhtml", page("<p>new</p>"), 1)], tables[1].schema)
    found = extract(spine, items)
    assert [(r["pos"], r["total"], r["title"]) for r in found.progress.orderBy("pos").collect()] == [(2, 3, "new"), (3, 3, "new")]
    assert found.summary.first()["total_items"] == 3


def test_empty_book_and_tables(spark, tables):
    spine = tables[0].limit(0)
    assert extract(spine, tables[1]).outputs.count() == 0
    blank = tables[1].withColumn("content", F.lit(b""))
    result = extract(tables[0], blank).summary
    assert (result.first()["total_items"], result.first()["chapter_count"], result.first()["non_chapter_count"]) == (7, 0, 0)
    assert [r["line"] for r in book.closing(result).collect()] == ["No chapter text found. The EPUB may use an unsupported structure."]
    assert result.select(book.state()).first()[0] == "failed"


def test_null_content_and_titles(spark, tables):
    spine = spark.createDataFrame([("b", 1, "x")], "book_id string, pos long, item_id string")
    items = spark.createDataFrame([("b", "x", "n.xhtml", None, 0)], tables[1].schema)
    assert [(r["title"], r["text"]) for r in book.chapters(spine, items).collect()] == [("n", "")]


def test_archive_rows():
    rows = list(read_archive(archive(spine=["one", "nowhere", "one"])))
    assert [r["item_id"] for r in rows if r["kind"] == "spine"] == ["one", "nowhere", "one"]
    assert [r["name"] for r in rows if r["kind"] == "item"] == [n for _, n, _ in ITEMS]


def test_epub_to_files(spark, epub, tmp_path):
    lines, events = [], []
    result = extract_epub(spark, str(epub), str(tmp_path / "out"), log=lines.append, on_progress=lambda *a: events.append(a))
    assert {str(p.relative_to(tmp_path / "out")): p.read_text("utf-8") for p in (tmp_path / "out").rglob("*.txt")} == TEXTS
    assert (result.total_items, result.chapter_count, result.non_chapter_count) == (7, 3, 3)
    assert len(events) == 7 and events[6] == (7, 7, "blank", None)
    assert lines[-2:] == [f"Wrote 3 chapter file(s) to {tmp_path}/out", f"Wrote 3 non-chapter file(s) to {tmp_path}/out/non-chapters-files"]


def test_cancel(spark, epub, tmp_path):
    asked = iter([False, False, True])
    lines = []
    result = extract_epub(spark, str(epub), str(tmp_path / "out"), log=lines.append, is_cancelled=lambda: next(asked))
    assert (result.total_items, result.chapter_count, result.cancelled) == (2, 0, True)
    assert lines[-1] == "Cancelled by user." and not list((tmp_path / "out").iterdir())


def test_many_books_and_a_broken_one(spark, epub):
    (epub.parent / "broken.epub").write_bytes(b"no archive")
    (epub.parent / "other.epub").write_bytes(archive(ITEMS[:3]))
    found = extract_paths(spark, str(epub.parent))
    assert sorted(r["total_items"] for r in found.summary.collect()) == [3, 7]
    assert read_books(spark, str(epub.parent)).errors.count() == 1


def test_bombs_and_entities_are_refused():
    bomb = archive([("a", "a.xhtml", "x" * (1 << 22)), ("b", "b.xhtml", "<p>b</p>")])
    rows = [r for r in read_archive(bomb) if r["kind"] != "spine"]
    assert [(r["kind"], r["item_id"]) for r in rows] == [("error", "a"), ("item", "b")] and "too large" in rows[0]["error"]
    assert [r["kind"] for r in read_archive(bomb, Limits(max_ratio=None)) if r["kind"] != "spine"] == ["item", "item"]
    assert [r["kind"] for r in read_archive(bomb, Limits(1000, None)) if r["kind"] != "spine"] == ["error", "item"]
    for encoding in ("utf-8", "utf-16"):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("META-INF/container.xml", '<!DOCTYPE a [<!ENTITY b "c">]><a/>'.encode(encoding))
        with pytest.raises(ValueError, match="entities"):
            list(read_archive(out.getvalue()))


def test_an_archive_that_states_a_wrong_size():
    data = bytearray(archive([("a", "a.xhtml", "<p>" + "word " * 400 + "</p>")]))
    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
        info = z.getinfo("OEBPS/a.xhtml")
    real = info.file_size.to_bytes(4, "little")
    lie = bytes(data).replace(real, (10).to_bytes(4, "little"))
    rows = [r for r in read_archive(lie, Limits(1000, None)) if r["kind"] != "spine"]
    assert len(rows) == 1 and len(rows[0].get("content") or b"") <= 1000


def test_document_types_and_missing_items(spark, tmp_path):
    kind = '<?xml version="1.0"?><!DOCTYPE package PUBLIC "+//ISBN 0-9673008-1-9//DTD OEB 1.2 Package//EN" "http://openebook.org/dtds/oeb-1.2/oebpkg12.dtd">'
    path = tmp_path / "old.epub"
    path.write_bytes(archive(before=kind, left_out=("two", "blank")))
    lines = []
    result = extract_epub(spark, str(path), str(tmp_path / "out"), log=lines.append)
    assert (result.total_items, result.chapter_count, result.non_chapter_count) == (7, 2, 3)
    assert sorted(x.split(":")[0] for x in lines[:2]) == ["  (unreadable, left out) blank.xhtml", "  (unreadable, left out) p-003.xhtml"]
    assert len([x for x in lines if x.startswith("  [")]) == 5


NAMES = ["[Author] Title.epub", "{a,b} *c*?.epub", "BOOK.EPUB", "100% a+b #1.epub", "back\\slash.epub", "no suffix", "本 １.epub"]


@pytest.mark.parametrize("name", NAMES)
def test_any_name_a_user_gives(spark, tmp_path, name):
    path = tmp_path / name
    path.write_bytes(archive(ITEMS[:3]))
    (tmp_path / "A.epub").write_bytes(archive(ITEMS))
    found = read_books(spark, str(path))
    assert (found.spine.count(), found.items.count(), found.errors.count()) == (3, 3, 0)


def test_folders_globs_and_lists(spark, tmp_path):
    for name in ("a.epub", "B.EPUB", "c.txt", "[d].Epub"):
        (tmp_path / name).write_bytes(archive(ITEMS[:2]))
    books = lambda *p: sorted(r[0].rpartition("/")[2] for r in read_books(spark, list(p)).spine.select("book_id").distinct().collect())
    assert books(str(tmp_path)) == ["B.EPUB", "[d].Epub", "a.epub"]
    assert books(f"{tmp_path}/[ac].*") == ["a.epub"]
    assert books(f"{tmp_path}/[d].Epub", f"{tmp_path}/c.txt", f"{tmp_path}/?.epub") == ["[d].Epub", "a.epub", "c.txt"]
    assert read_books(spark, []).items.count() == 0


def test_null_and_broken_archives(spark):
    files = spark.createDataFrame([(1, bytearray(archive(ITEMS[:2]))), (2, None), (3, bytearray(b"x")), (None, bytearray(archive(ITEMS[:1])))], "book_id long, content binary")
    found = read_archives(files)
    assert sorted((str(r["book_id"]), r["item_id"]) for r in found.items.collect()) == [("1", "front"), ("1", "words"), ("None", "front")]
    assert sorted(r["book_id"] for r in found.errors.collect()) == [2, 3]


def test_archives_are_unpacked_once(spark, epub):
    plan = read_books(spark, str(epub)).items._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "binaryFile" not in plan


def test_a_stop_leaves_later_items_unparsed(spark, epub, tmp_path, monkeypatch):
    monkeypatch.setattr(E, "FIRST", 2)
    parsed = []
    plain = E.table
    monkeypatch.setattr(E, "table", lambda df, name: parsed.append(plain(df, name)) or parsed[-1])
    seen, asked = [], []

    def cancelled():
        asked.append(len(seen))
        return len(asked) == 3

    result = extract_epub(spark, str(epub), str(tmp_path / "out"), log=seen.append, is_cancelled=cancelled)
    assert (result.total_items, result.cancelled, len(parsed)) == (2, True, 1)
    assert asked == [0, 1, 2] and parsed[0].count() == 2  # reported before the next is parsed


def drained(run):
    out = []
    while not run.messages.empty():
        out.append(run.messages.get())
    return out


def test_runs_report_check_and_end(spark, epub, tmp_path):
    run = Run(spark, f" {epub} ", str(tmp_path / "o"))
    run.start()
    other = Run(spark, str(epub), str(tmp_path / "p"))
    with pytest.raises(ValueError, match="another extraction"):
        other.start()
    assert run.wait() == "completed"
    messages = drained(run)
    assert [m[1] for m in messages if m[0] == "progress"] == [1, 2, 3, 4, 5, 6, 7]
    assert messages[-1][0] == "result" and messages[-1][1].chapter_count == 3
    assert [m[2] for m in messages if m[0] == "log"][-2:] == ["success", "success"]
    (tmp_path / "file").write_text("")
    for path, out, why in (("", "o", "no such EPUB"), (str(tmp_path), "o", "no such EPUB"), (str(epub), " ", "no output folder"), (str(epub), str(tmp_path / "file" / "x"), "cannot make")):
        with pytest.raises(ValueError, match=why):
            Run(spark, path, out).start()
    assert Run._active is None


def test_runs_hint_fail_and_cancel(spark, tmp_path):
    for name, data in (("plain", archive(ITEMS[:2])), ("empty", archive(ITEMS[6:])), ("broken", b"x")):
        (tmp_path / f"{name}.epub").write_bytes(data)
    ends = {}
    for name in ("plain", "empty", "broken"):
        run = Run(spark, str(tmp_path / f"{name}.epub"), str(tmp_path / name))
        run.start()
        ends[name] = run.wait(), drained(run)
    assert [ends[n][0] for n in ends] == ["completed", "failed", "failed"]
    assert any("all 2 item(s)" in m[1] for m in ends["plain"][1] if m[0] == "log") and ends["broken"][1][-1][0] == "error"
    run = Run(spark, str(tmp_path / "plain.epub"), str(tmp_path / "late"))
    run.start()
    run.cancel()
    begun = time.monotonic()
    assert run.wait() == "cancelled" and time.monotonic() - begun < 60
    assert drained(run)[-1][1].cancelled and not os.listdir(tmp_path / "late")


def test_sink_overwrites_and_stays_inside(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", "é\n"), ("c.txt", "")], "rel_path string, text string")
    (tmp_path / "c.txt").write_text("old")
    write_files(rows, str(tmp_path))
    assert (tmp_path / "a/b.txt").read_bytes() == "é\n".encode() and (tmp_path / "c.txt").read_text() == ""
    assert not [p for p in Path(tmp_path).rglob("*.part")]
    with pytest.raises(ValueError, match="leads out"):
        safe_target(str(tmp_path), "../x.txt")


def test_sink_writes_below_a_uri(spark, tmp_path):
    rows = spark.createDataFrame([("a/b [1].txt", "é\n")], "rel_path string, text string")
    write_files(rows, f"file://{tmp_path}/x")
    assert (tmp_path / "x/a/b [1].txt").read_bytes() == "é\n".encode()
    with pytest.raises(Exception, match="leads out"):
        write_files(rows.withColumn("rel_path", F.lit("../y.txt")), f"file://{tmp_path}/x")


def test_cli(spark, epub, tmp_path, capsys):
    assert cli.main([str(tmp_path / "none.epub")]) == 1
    assert "File not found" in capsys.readouterr().err
    assert cli.main([str(epub), "-o", str(tmp_path / "o"), "--flat"]) == 0
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == FLAT
    assert cli.config(cli.arguments(["x", "--keep-furigana", "--single-file", "--keep-scene-markers"])) == book.Config(True, True, True, True)


def test_log_tags_and_hint(spark):
    lines = ["Wrote 3 chapter file(s) to x", "Cancelled by user.", '  [001/002] item: "a" (1 chars)', '  [001/002] item: "Cancelled" (1 chars)', " ", "Wrote nothing"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    assert [r[0] for r in rows.orderBy("i").select(book.log_tag(F.col("line"))).collect()] == ["success", "error", "text", "error", None, "text"]
    result = spark.createDataFrame([("a", 0, 2, False), ("b", 1, 2, False), ("c", 0, 0, True)], "book_id string, chapter_count long, non_chapter_count long, cancelled boolean")
    assert [tuple(r) for r in book.unmatched(result).collect()] == [("a", 2, book.HINT % 2)]
    assert book.unmatched(result, book.Config(detect_chapters=False)).count() == 0
