from test_book import archive

from tessera.extract import extract_paths
from tessera.sources.epub import Limits


def test_refused_archives_are_named(spark, tmp_path):
    (tmp_path / "good.epub").write_bytes(archive([("a", "a.xhtml", "<p>text</p>")]))
    (tmp_path / "large.epub").write_bytes(archive([("a", "a.xhtml", "x" * (1 << 22))]))
    found = extract_paths(spark, str(tmp_path))
    assert sorted(r["non_chapter_count"] for r in found.summary.collect()) == [0, 1]
    assert [(r["book_id"].rpartition("/")[2], r["item_id"], "too large" in r["error"]) for r in found.errors.collect()] == [("large.epub", "a", True)]
    assert extract_paths(spark, str(tmp_path), limits=Limits(max_ratio=None)).errors.count() == 0
