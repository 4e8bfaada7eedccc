import random

import numpy as np
import pytest
from fixtures import BYTES, documents, frame, words

import corpus_pipeline
from tessera.llm import near_copies as N


def plain_set(text, width=5):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = BYTES.findall(lower)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain_kept(rows):
    """Least ids of the components of all pairs of similarity 0.8 or more."""
    sets, parent = [plain_set(r[1]) for r in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {rows[i][0] for i in range(len(rows)) if root(i) == i}


def edited(seed=3):
    """Texts and copies with 1 to 8 of 200 words replaced: similarities on both sides of 0.8."""
    rng = random.Random(seed)
    out = [t for _, t, *_ in documents()]
    for _ in range(12):
        base = words(200, rng).split()
        out.append(" ".join(base))
        for n in range(1, 9):
            copy = list(base)
            for at in rng.sample(range(200), n):
                copy[at] = f"new{rng.randrange(10**6)}"
            out.append("  ".join(copy).upper() if n % 2 else "\n".join(copy))
    return [(i, t, None, "s", 0, 0) for i, t in enumerate(out)]


@pytest.mark.parametrize("large", [256, 3])
def test_stage_keeps_one_of_all_that_are_similar(spark, monkeypatch, large):
    """Far copies (10 bits of SimHash) are found, and pairs under 0.8 are not."""
    rows = edited()
    expected = plain_kept(rows)
    monkeypatch.setattr(N.representatives, "__defaults__", (*N.representatives.__defaults__[:-1], large))
    kept = corpus_pipeline.near_copies(spark, frame(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(expected)


def test_null_and_repeated_ids(spark, empty):
    assert N.representatives(empty).count() == 0
    rows = [(d, t, "en", "s", 0, 0) for d, t in [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "x y"), (None, "x  Y"), (7, "one two"), (9, "One two"), (3, None), (4, " ")]]
    found = N.representatives(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "").lower().split()) for r in found) == [("3", []), ("7", ["a", "b", "c", "d", "e"]), ("7", ["one", "two"]), ("None", ["x", "y"])]


def test_forest_counts_exactly():
    sets = [np.arange(10), np.arange(1, 10), np.arange(2, 10), np.arange(3, 10), np.zeros(0, int), np.arange(20, 30)]
    bounds = np.cumsum([0, *map(len, sets)])
    edges = set(zip(*(x.tolist() for x in N.forest(np.concatenate(sets), bounds, 80)), strict=True))
    assert edges == {(0, 1), (0, 2), (2, 3)}
