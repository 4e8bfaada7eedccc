import random

import numpy as np
import pytest
from fixtures import documents, frame, words

from tessera.llm import decontaminate as D

ITEMS = [(i, words(30, random.Random(100 + i)).capitalize() + ".") for i in range(12)]


def distance(pattern, text):
    """Least edits between the pattern and any part of the text."""
    now = np.zeros(len(text) + 1, int)
    for i, c in enumerate(pattern, 1):
        new = np.empty_like(now)
        new[0] = i
        for j, d in enumerate(text, 1):
            new[j] = min(now[j - 1] + (c != d), now[j] + 1, new[j - 1] + 1)
        now = new
    return int(now.min())


def table(spark, items):
    return spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, start int")


def edited(text, n, rng):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        rng.choice((lambda: chars.__setitem__(at, "ß"), lambda: chars.insert(at, "ß"), lambda: chars.pop(at)))()
    return "".join(chars)


def found(spark, rows, items, **params):
    out = D.leaks(frame(spark, rows), table(spark, items), D.Params(**params)).collect()
    return {(r["doc_id"], r["item_id"]): r for r in out}


def test_equals_the_best_alignment_of_every_pair(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        item = ITEMS[i % 12][1]
        rows.append((i, words(40, rng) + " " + edited(item, i % 16, rng) + " " + words(40, rng), "en", "s", 0, 0))
    got = found(spark, rows, ITEMS)
    plain = lambda t: " ".join(t.lower().split())
    for i in range(60):
        item = plain(ITEMS[i % 12][1])
        best, allowed = distance(item, plain(rows[i][1])), int(0.05 * len(item))
        assert ((i, i % 12) in got) == (best <= allowed)
        if best <= allowed:
            assert got[i, i % 12]["edits"] == best
    assert all(k[0] % 12 == k[1] for k in got)


def test_offsets_are_those_of_the_original(spark):
    item = ITEMS[0][1]
    text = "😀 É\n\n  " + item.upper().replace(" ", "  \n") + " tail"
    row = found(spark, [(1, text, "en", "s", 0, 0)], ITEMS)[1, 0]
    assert text[row["start"] : row["end"]].lower().split() == item.lower().split() and row["edits"] == 0


def test_copies_long_items_blocks_and_short_items(spark):
    long = words(400, random.Random(77))
    part = " ".join(long.split()[100:330])
    items = [*ITEMS, (50, long), (51, "short"), (52, ""), (53, None), (54, "exactly twelve")]
    rows = [(1, ITEMS[3][1] + " and " + ITEMS[3][1], "en", "s", 0, 0), (2, part, "en", "s", 0, 0), (3, "(Short)", "en", "s", 0, 0), (4, "now EXACTLY  twelve times", "en", "s", 0, 0), (5, "shorter", "en", "s", 0, 0)]
    for block in (10**7, 500):
        out = D.leaks(frame(spark, rows), table(spark, items), D.Params(block_chars=block)).collect()
        assert [r["item_id"] for r in out if r["doc_id"] == 1] == [3, 3]
        assert {r["item_id"] for r in out if r["doc_id"] == 2} == {50} and not [r for r in out if r["doc_id"] == 5]
        assert [(r["item_id"], r["start"], r["end"]) for r in out if r["doc_id"] == 3] == [(51, 1, 6)]
        assert [r["item_id"] for r in out if r["doc_id"] == 4] == [54]
        assert sorted(r["doc_id"] for r in D.clean(frame(spark, rows), table(spark, items), D.Params(block_chars=block)).collect()) == [5]


def test_items_of_every_short_length_equal_the_best_alignment():
    """Short items with no edit, one edit and two, beside others, against all alignments."""
    rng = random.Random(21)
    items = [(n, words(30, random.Random(n))[:n].strip() + "q" * (n - len(words(30, random.Random(n))[:n].strip()))) for n in range(1, 46)]
    assert [len(t) for _, t in items] == list(range(1, 46))
    texts = [words(6, rng) + rng.choice((" ", "x", ", ")) + edited(t, e, rng) + rng.choice((" ", "", "é", ".")) + words(6, rng) for _, t in items for e in (0, 0, 1, 2) if n_edits(t, e)]
    index = D.Index(items, D.Params())
    got = {(t, item) for t, item, *_ in index.search(texts)}
    for i, text in enumerate(" ".join(t.split()) for t in texts):
        for n, item in items:
            allowed = int(0.05 * n)
            if n >= 12:
                expected = distance(item, text) <= allowed
            else:
                expected = any(text.startswith(item, at) and not (at and text[at - 1].isalnum()) and not text[at + n : at + n + 1].isalnum() for at in range(len(text)))
            assert ((i, n) in got) == expected, (item, text)


def n_edits(text, edits):
    return edits == 0 or len(text) > 1


def test_equal_items_are_searched_once(spark):
    rows = [(1, ITEMS[3][1], "en", "s", 0, 0)]
    same = [(i, ITEMS[3][1]) for i in (9, 7, 8)] + [(None, ITEMS[3][1]), (None, ITEMS[4][1])]
    for block in (10**7, 200):
        out = D.leaks(frame(spark, rows), table(spark, same), D.Params(block_chars=block)).collect()
        assert [r["item_id"] for r in out] == [7]


@pytest.mark.parametrize("size", [40, 333, 1000])
def test_long_texts_in_segments(monkeypatch, size):
    rng = random.Random(9)
    items = [*ITEMS, (50, "yes"), (51, "ten of all"), (52, words(300, random.Random(78)))]
    parts = [edited(t, rng.randrange(3), rng) for _, t in items] + ["   \n " * 200, "yes", "eyes", "ten  of   all", "yess"] + [words(9, rng) for _ in range(20)]
    texts = [" ".join(rng.sample(parts, len(parts))) for _ in range(4)] + [None, "yes", "x" * 500]
    index = D.Index(items, D.Params())
    whole = sorted(index.search(texts))
    monkeypatch.setattr(D, "SEGMENT", size)
    assert sorted(index.search(texts)) == whole and len(whole) > 50


def test_hits_counted_in_parts(monkeypatch):
    rng = random.Random(5)
    texts = [edited(t, 3, rng) + " " + words(20, rng) for _, t in ITEMS] * 2
    index = D.Index(ITEMS, D.Params())
    whole = sorted(index.search(texts))
    monkeypatch.setattr(D, "SPREAD", 7)
    assert sorted(index.search(texts)) == whole and len(whole) == 24


@pytest.mark.parametrize("items", [[], [(1, None)], ITEMS])
def test_awkward_texts_and_empty_tables(spark, docs, empty, items):
    bench = table(spark, items)
    assert D.leaks(docs, bench).count() == 0 == D.leaks(empty, bench).count()
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(documents()) and D.clean(empty, bench).count() == 0
