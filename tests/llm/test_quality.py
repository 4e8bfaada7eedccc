import math
import random

import numpy as np
import pyarrow as pa
import pytest
from fixtures import base_counts, documents, frame, words

from tessera.llm import kernel
from tessera.llm import pairwise_quality as P
from tessera.llm import quality_rules as Q
from tessera.llm.shared import texts

LABELS = "doc_id long, quality int"


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        w = words(40, rng).split()
        text = " ".join(x + rng.choice(("$$$", "%%%", "###")) if bad else x for x in w) + "."
        rows.append((i, text, "en" if i % 2 else "de", "s", len(text), 0))
        labels.append((i, int(not bad)))
    return rows, labels


def test_base_counts_equal_brute_force(docs):
    found = Q.measured(docs).collect()
    assert {r["doc_id"]: tuple(r[k] for k in Q.BASE) for r in found} == {d[0]: base_counts(d[1]) for d in documents()}
    p = Q.Params()
    assert all(r["base_failed"] == (r["n_words"] < p.min_words or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in found)


@pytest.mark.parametrize("k, n", [(0, 10), (3, 100), (17, 300), (0, 700)])
def test_binomial_tail_is_exact(k, n):
    for share, delta in ((0.01, 0.05), (0.1, 0.01)):
        tail = sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1))
        assert Q.certified(k, n, share, delta) == (tail <= delta)


def test_cutoffs_hold_their_promise():
    """Over many holdouts, the chosen cutoff rejects over the share in under delta of them."""
    rng = np.random.default_rng(3)
    truth = np.linspace(1, 0, Q.CELLS) ** 6 + 1e-3
    truth /= truth.sum()
    tail, over = np.cumsum(truth[::-1])[::-1], 0
    for _ in range(300):
        good = np.bincount(rng.choice(Q.CELLS, 2000, p=truth), minlength=Q.CELLS)
        bad = np.bincount(rng.choice(Q.CELLS, 500), minlength=Q.CELLS)
        c = Q.choose(good, bad, 0.02, 0.05, 0.0)
        over += c < Q.CELLS and tail[c] > 0.02
    assert over <= 25


def test_bad_texts_go_and_good_ones_stay(spark):
    rows, labels = corpus()
    docs, given = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    p = Q.Params(alpha=0.2)
    cutoffs = Q.calibrate(Q.measured(docs, p), given, p)
    judged = Q.judged(Q.measured(docs, p), cutoffs)
    kept = {r["doc_id"] for r in judged.collect() if r["kept"]}
    assert kept == {i for i, good in labels if good}
    assert {r["doc_id"] for r in Q.keep(docs, cutoffs, p).collect()} == kept
    assert Q.keep(docs, cutoffs, p).columns == docs.columns


def test_a_small_odd_stratum_keeps_its_good_texts(spark):
    """All good texts of a language with few labels look like the bad ones of another."""
    at = lambda cell: [cell, 0, 0, 0]
    given = [("en", at(0), 1, 9000), ("en", at(40), 0, 2000), ("code", at(40), 1, 40), ("xx", at(40), None, 5), (Q.NONE, at(40), 1, 3)]
    rows = [(stratum, cells, label) for stratum, cells, label, n in given for _ in range(n)]
    kind = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, cells array<int>"
    measured = spark.createDataFrame([(i, s, 50, 200, 9, 0, 0, False, c) for i, (s, c, _) in enumerate(rows)], kind)
    labels = spark.createDataFrame([(i, label) for i, (_, _, label) in enumerate(rows)], LABELS)
    cutoffs = Q.calibrate(measured, labels)
    assert set(cutoffs.cells) == {"en"} and cutoffs.of("en")[0] <= 40 and cutoffs.of("code") == (Q.CELLS,) * 4
    gone = {r["doc_id"] for r in Q.judged(measured, cutoffs).where("not kept").collect()}
    assert gone == {i for i, (s, c, _) in enumerate(rows) if s == "en" and c[0] == 40}


def test_labelled_rows_alone_give_the_same_cutoffs(spark, monkeypatch):
    rows, labels = corpus()
    docs, given, p = frame(spark, rows), spark.createDataFrame(labels[:700] + [(5000, 1), (None, 0)], LABELS), Q.Params(alpha=0.2)
    whole = Q.calibrate(Q.measured(docs, p), given, p)
    assert Q.labelled(docs, given).count() == 700 and Q.labelled(docs, given).columns == docs.columns
    assert Q.calibrate(Q.measured(Q.labelled(docs, given), p), given, p) == whole and whole.cells
    monkeypatch.setattr(Q, "SENT_IDS", 10)
    assert Q.labelled(docs, given).count() == len(rows)


def test_without_labels_only_the_base_rule_rejects(spark, docs, empty):
    none = spark.createDataFrame([], LABELS)
    cutoffs = Q.calibrate(Q.measured(docs), none)
    assert all(r["kept"] != r["base_failed"] for r in Q.judged(Q.measured(docs), cutoffs).collect())
    assert Q.keep(docs, cutoffs).count() == Q.judged(Q.measured(docs), cutoffs).where("kept").count()
    assert Q.judged(Q.measured(empty), cutoffs).count() == 0 == Q.keep(empty, cutoffs).count()
    nulls = spark.createDataFrame([(1, None), (None, 1)], LABELS)
    assert Q.calibrate(Q.measured(docs), nulls).of("en") == (Q.CELLS,) * len(Q.RULES)


def test_pairwise_scores_hold_on_held_out_texts(spark):
    rows, labels = corpus()
    docs = frame(spark, rows)
    train = spark.createDataFrame([x for x in labels if x[0] % 3], LABELS)
    model = P.fit(docs, train)
    found = {r["doc_id"]: r for r in P.score(docs, model).collect()}
    assert all(found[i]["predicted"] == good for i, good in labels if i % 3 == 0)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())
    again = P.fit(docs.repartition(7), train)
    assert np.allclose(again.weight, model.weight) and math.isclose(again.threshold, model.threshold)


def test_pairwise_loss_is_minimal():
    rng = np.random.default_rng(4)
    x, label = rng.normal(size=(400, 3)), rng.integers(0, 2, 400)
    x[label == 1] += 0.3
    p = P.Params(pairs=5000, l2=1e-3)
    m = P.fit_pairs(x, label, p)
    z, pick = (x - m.mean) / m.scale, np.random.default_rng(p.seed)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    d = z[pick.choice(good, p.pairs)] - z[pick.choice(bad, p.pairs)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + p.l2 / 2 * w @ w
    assert all(loss(m.weight) <= loss(m.weight + step) for step in rng.normal(scale=0.05, size=(50, 3)))
    assert (z @ m.weight < m.threshold).sum() == len(bad)


def test_pairwise_edge_cases(spark, docs, empty):
    none = spark.createDataFrame([], LABELS)
    model = P.fit(docs, none)
    assert {r["predicted"] for r in P.score(docs, model).collect()} == {1}
    assert P.score(empty, model).count() == 0
    assert P.score(docs, model).count() == len(documents())
    one = spark.createDataFrame([(i, 0) for i in range(20)], LABELS)
    assert {r["predicted"] for r in P.score(docs, P.fit(docs, one)).collect()} == {0}


def mixed(n, seed=5):
    """Rows, labels that texts foretell only in part, and the texts' features."""
    rows, labels = corpus(n, seed)
    rng = random.Random(seed)
    labels = [(i, good if rng.random() < 0.9 else 1 - good) for i, good in labels]
    return rows, labels, P.features(kernel.basics(*texts(pa.array([r[1] for r in rows]))))


def over_all_pairs(m, x, label, p=P.Params()):
    """The gradient of the mean loss over every pair, pair by pair."""
    z = (x - m.mean) / m.scale
    good, bad = z[label == 1], z[label != 1]
    s, total = bad @ m.weight, np.zeros(x.shape[1])
    for block in np.array_split(good, len(good) // 500 + 1):
        q = 1 / (1 + np.exp((block @ m.weight)[:, None] - s))
        total += q.sum(1) @ block - q.sum(0) @ bad
    return total / len(good) / len(bad) - p.l2 * m.weight


def test_pairwise_model_is_of_all_pairs_of_all_labelled_rows(spark):
    rows, labels, x = mixed(21_000)
    docs, label = frame(spark, rows).repartition(6), np.array([good for _, good in labels])
    m = P.fit(docs, spark.createDataFrame(labels, LABELS))
    s, bad = np.sort((x - m.mean) / m.scale @ m.weight), (label == 0).sum()
    assert np.allclose(m.mean, x.mean(0)) and math.isclose(m.threshold, (s[bad - 1] + s[bad]) / 2, rel_tol=1e-9)
    assert np.abs(over_all_pairs(m, x, label)).max() < 1e-8
    assert P.score(docs, m).where("predicted = 0").count() == (s < m.threshold - 1e-9).sum()


def test_pairwise_moments_give_loss_and_slopes_of_all_pairs():
    rng, p = np.random.default_rng(6), P.Params()
    x, label = rng.standard_cauchy(size=(300, 4)), rng.integers(0, 2, 300)
    d = (x[label == 1][:, None] - x[label == 0]).reshape(-1, 4)
    for w in (np.zeros(4), np.array([0.3, -1, 2, 0.01]), np.array([9.0, 30, -1, 4])):
        parts = [P.moments(x[i::3], label[i::3] == 1, w) for i in range(3)]
        for found, plain in zip(P.slopes(P.added(parts), w, p), P._drawn(d, w, p)):
            assert np.allclose(found, plain, rtol=1e-10, atol=1e-10)


def test_pairwise_fit_is_the_same_by_shuffle_in_a_tree_and_in_memory(spark, monkeypatch):
    """With repeated rows and labels, null labels, labels of no row, and rows of no label."""
    rows, labels, x = mixed(300)
    rows, at = rows + rows[:40], list(range(300)) + list(range(40))
    given = labels[:250] + labels[20:30] + [(5000, 1), (6000, 0), (7, None), (299, None), (None, 0)]
    picked = [(i, good) for j, good in given if j is not None and j < 300 and good is not None for i in at if i == j]
    docs, train = frame(spark, rows).repartition(8), spark.createDataFrame(given, LABELS)
    plain = P.fit_pairs(x[[i for i, _ in picked]], np.array([good for _, good in picked]))
    same = lambda m: all(np.allclose(getattr(m, k), getattr(plain, k), rtol=1e-6, atol=1e-8) for k in ("mean", "scale", "weight", "threshold", "spread"))
    assert same(P.fit(docs, train))
    monkeypatch.setattr(P, "SENT_IDS", 10)
    monkeypatch.setattr(P, "FAN", 2)
    assert same(P.fit(docs, train))
    few = P.Params(pairs=500)
    assert np.allclose(P.fit(docs, train, few).weight, P.fit(docs.repartition(3), train, few).weight)


def test_pairwise_threshold_is_the_exact_quantile_with_ties(spark):
    keys = np.array([3.5, -1e300, -0.0, 0.0, 2.0**-1074, -2.5, 3.5, 3.5, 1e9])
    coded = P._ordered((keys + 0.0).view(np.int64))
    assert [P._score_of(k) for k in np.sort(coded)] == sorted(keys)
    table = spark.createDataFrame([(int(k),) for k in coded], "_key long")
    assert [P._at_rank(table, i) for i in range(len(keys))] == sorted(coded)
    rows, _ = corpus(60)
    docs = frame(spark, [(i, rows[i % 3][1], *r[2:]) for i, r in enumerate(rows)])
    tied = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(60)], LABELS)
    m = P.fit(docs, tied)
    found = {r["doc_id"]: r["score"] for r in P.score(docs, m).collect()}
    at_least = sorted(found.values())[12]
    assert {r["doc_id"] for r in P.score(docs, m).where("predicted = 1").collect()} == {i for i, s in found.items() if s >= at_least}
