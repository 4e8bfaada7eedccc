"""Text functions against plain Python statements of the rules."""

import itertools

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X


def values(spark, cases, f):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string")
    return [r["y"] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_strip_takes_all_unicode_white_space(spark):
    cases = [f"{w} a b{w}\n" for w in ("　", "\xa0", "\x85", "\x1c", " ", "\t", " ")] + ["", " ", "a"]
    assert values(spark, cases, X.strip) == [c.strip() for c in cases]


def test_strip_leaves_other_code_points(spark):
    cases = ["​x​", "﻿x", "᠎x"]
    assert values(spark, cases, X.strip) == cases


def test_collapse_newlines(spark):
    assert values(spark, ["foo\n  bar", "a \r\n\t b", "a b", "\n"], X.collapse_newlines) == ["foobar", "ab", "a b", ""]


DIVIDERS = {"＊": True, "ーー": True, "-~-": True, "※": False, "＊ ＊": False, "＊" * 10: True, "＊" * 11: False, "": False, "＊\n": False}


def test_dividers(spark):
    assert values(spark, list(DIVIDERS), X.is_divider) == list(DIVIDERS.values())


def joined(paragraphs):
    """Runs of paragraphs that are not empty: one line break within a run, two between runs."""
    runs = [list(group) for full, group in itertools.groupby(paragraphs, bool) if full]
    return "\n\n".join("\n".join(run) for run in runs)


def test_join_paragraphs_equals_grouping(spark):
    cases = [list(c) for n in range(7) for c in itertools.product(("", "a", "b"), repeat=n)]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ps array<string>")
    found = [r["y"] for r in rows.select("i", X.join_paragraphs(F.col("ps")).alias("y")).orderBy("i").collect()]
    assert found == [joined(c) for c in cases]


TITLES = {"１": True, "16": True, "第一章": True, "第3話": True, "Chapter 5": True, "chapter　12": True, " 7　": True, "スプートニクの恋人": False, "text00000": False, "": False,
          "CHAPTER 5": False, "第〇章": False, "第万章": False, "第一節": False, "第一章 始まり": False, "プロローグ": False, "1.": False, "1\x85": True, None: False}


def test_chapter_titles(spark):
    assert values(spark, list(TITLES), X.is_chapter_title) == list(TITLES.values())


def test_chapter_titles_are_configurable(spark):
    assert values(spark, ["Part I", "1"], lambda c: X.is_chapter_title(c, ("Part [IVX]+",))) == [True, False]
    assert values(spark, ["1"], lambda c: X.is_chapter_title(c, ())) == [False]


@pytest.mark.parametrize("name, expected", [("a/b:c?", "a_b_c_"), ("  ", "untitled"), ("", "untitled"), (" a 　 b ", "a b"), ("x" * 70, "x" * 60), ("a" * 59 + " b", "a" * 59 + " "), ('\\*"<>|', "______"), ("😀" * 61, "😀" * 60)])
def test_safe_filename(spark, name, expected):
    assert values(spark, [name], X.safe_filename) == [expected]


def test_stem_equals_pathlib(spark):
    from pathlib import PurePosixPath

    cases = ["text/a.xhtml", "a.b.c", ".a", "a.", "..a", "a", "x/y/", "a.tar.gz", "b/.hidden.txt", "https://x.example/en/12"]
    assert values(spark, cases, X.stem) == [PurePosixPath(c).stem for c in cases]


def test_padded_keeps_long_numbers(spark):
    assert [r[0] for r in spark.sql("SELECT id FROM VALUES (1L), (999L), (1234L) t(id)").select(X.padded(F.col("id"))).collect()] == ["001", "999", "1234"]


def test_duration_and_percent(spark):
    r = spark.range(1).select(X.duration(F.lit(3725.9)), X.duration(F.lit(0)), X.percent(F.lit(29), F.lit(100)), X.percent(F.lit(1), F.lit(0)), X.duration(F.lit(360_000))).first()
    assert list(r) == ["01:02:05", "00:00:00", 28, 0, "100:00:00"]
