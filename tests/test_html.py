"""The parser and what is made of it, case by case."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.html import parse_document, parsed
from tessera.operators import document

RUBY = "<p><ruby>漢<rp>(</rp><rt>かん</rt><rp>)</rp>字<rt>じ</rt></ruby></p>"
TEXTS = [
    (RUBY, {}, "漢字"),
    (RUBY, {"keep": True}, "漢字(かんじ)"),
    ("<p><ruby>空<rt></rt></ruby></p>", {"keep": True}, "空"),
    ("<p><ruby>空<rt>\n</rt></ruby></p>", {"keep": True}, "空()"),
    ("<p>a<ruby>b<rt>c</p><p>d</p>", {"keep": True}, "ab(c)\nd"),
    ("<p>a<br/>b</p>", {}, "ab"),
    ("<p>foo\n  bar</p>", {}, "foobar"),
    ("<p>　a　</p>", {}, "a"),
    ("<p>※</p>", {}, "※"),
    ("<p>x</p><p>＊</p><p>y</p>", {}, "x\n\ny"),
    ("<p>＊</p>", {"markers": True}, "＊"),
    ("<p>＊＊＊＊＊＊＊＊＊＊＊</p>", {}, "＊" * 11),
    ("<li>a<p>b</p></li>", {}, "ab"),
    ("<div>x</div><p>y</p>", {}, "y"),
    ("<html><head><title>T</title></head><body><div>x</div>", {}, "Tx"),
    ("<div>＊</div>", {}, "＊"),
    ("<p>a</p><p><br/></p><p>b</p>", {}, "a\n\nb"),
    ("<p>a<p>b<h1>c</h1>d", {}, "a\nb\nc"),
    ("<p><b>x<br></article>", {}, "x"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", {}, "ab\nc"),
    ("<p>a<script>if (a < b) '<p>no</p>'</script><style>p{}</style>b</p>", {}, "ab"),
    ("<p>a<!-- <p>no</p> -->b</p>", {}, "ab"),
    ("<p>a &amp; &lt;b&gt; &#x3042;</p>", {}, "a & <b> あ"),
    ("<h1>＊</h1><p>x</p>", {}, "x"),
    ("", {}, ""),
    (None, {}, ""),
    ("<body></body>", {}, ""),
]
TITLES = [
    ("<h1> </h1><h1>A</h1><h2>B</h2>", "B"),
    ("<title>T</title><h3>C</h3>", "C"),
    ("<title>T</title>", "T"),
    ("<h1>a<ruby>漢<rt>かん</rt></ruby>\n b</h1>", "a漢b"),
    ("<h1>＊</h1>", "＊"),
    ("<p>x</p>", "fallback"),
    ("<h1></h1><h2>　</h2>", "fallback"),
]


def frame(spark, html, keep=False):
    return spark.createDataFrame([(html,)], "html string").select(parsed(F.col("html"), keep).alias("p"))


@pytest.mark.parametrize("html, options, expected", TEXTS)
def test_text(spark, html, options, expected):
    rows = frame(spark, html, options.get("keep", False))
    assert rows.select(document.document_text(F.col("p"), options.get("markers", False))).first()[0] == expected


@pytest.mark.parametrize("html, expected", TITLES)
def test_title(spark, html, expected):
    assert frame(spark, html).select(document.document_title(F.col("p"), F.lit("fallback"))).first()[0] == expected


def test_bytes_are_decoded():
    assert parse_document("<p>é</p>".encode())[0] == ["é"]
    assert parse_document(b"\xef\xbb\xbf" + "<p>é</p>".encode())[0] == ["é"]
    assert parse_document('<?xml version="1.0" encoding="shift_jis"?><p>漢</p>'.encode("shift_jis"))[0] == ["漢"]
    assert parse_document(b'<meta charset="nonsense"><p>x</p>')[0] == ["x"]
    assert parse_document(b"<p>\xff</p>")[0] == ["�"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<li>", "</li>", "<ul>", "</ul>", "<h1>", "</h1>", "<ruby>", "</ruby>", "<rt>", "<div>", "</div>", "x", " ", "\n", "<br>", "<title>", "</title>", "&amp;"])))
def test_any_tags_parse(parts):
    blocks, h1, h2, h3, title, whole = parse_document("".join(parts))
    assert all(isinstance(b, str) for b in blocks)
    assert sum(len(b) for b in blocks) <= len(whole)


def test_one_python_node_per_parse(spark):
    rows = frame(spark, "<p>x</p>").select(document.document_text(F.col("p")), document.document_title(F.col("p"), F.lit("")))
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
