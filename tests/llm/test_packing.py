import random
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import documents
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing as P
from tessera.llm.queries import tokenizer_path


def laid_out(rows, counts):
    """sequence -> [(offset, length)] of a plan."""
    out, seen = {}, Counter()
    for length, rank, n, copies, first, offset in rows.tolist():
        for i in range(n):
            out.setdefault(first + i // copies, []).append((offset + i % copies * length, length))
            seen[length, rank + i] += 1
    assert seen == Counter({(k, i): 1 for k, n in counts.items() for i in range(n)})
    return out


def checked(counts, p):
    bins = laid_out(P.plan(counts, p), counts)
    assert sorted(bins) == list(range(len(bins)))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
        assert sum(x for _, x in own) <= p.tokens and len(own) <= p.documents and sum(x * x for _, x in own) <= p.attention
    return len(bins)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12), st.sampled_from(["norm", "dot"]), st.sampled_from([(32, 1024), (3, 1024), (32, 300), (32, 1100)]))
def test_plans_fit_every_capacity(counts, score, caps):
    p = P.Params(tokens=32, documents=caps[0], attention=caps[1], score=score, weights=(1.0, 0.5, 0.5))
    counts = {k: n for k, n in counts.items() if k * k <= p.attention}
    assert checked(counts, p) >= -(-sum(k * n for k, n in counts.items()) // 32)


def test_plan_is_best_fit_one_by_one():
    """The ranges place pieces as a packer of single pieces does: as many bins."""
    rng = random.Random(1)
    for _ in range(30):
        lengths = sorted((rng.randint(1, 64) for _ in range(rng.randint(1, 300))), reverse=True)
        rest = []
        for x in lengths:
            fits = [i for i, r in enumerate(rest) if r >= x]
            if fits:
                rest[min(fits, key=lambda i: rest[i])] -= x
            else:
                rest.append(64 - x)
        assert checked(dict(Counter(lengths)), P.Params(tokens=64, documents=64, attention=64 * 64)) == len(rest)


def one_by_one(lengths, p):
    """Best fit of single pieces by their vectors: the least weighted residual norm, or the largest dot product."""
    caps, weights, bins = np.array([p.tokens, p.documents, p.attention]), np.array(p.weights), []
    for x in sorted(lengths, reverse=True):
        need, best = np.array([x, 1, x * x]), None
        for i, rest in enumerate(bins):
            if (rest >= need).all():
                score = np.sqrt((weights * ((rest - need) / caps) ** 2).sum()) if p.score == "norm" else -(weights * rest / caps * need / caps).sum()
                if best is None or score < best[0] - 1e-12:
                    best = score, i
        if best:
            bins[best[1]] = bins[best[1]] - need
        else:
            bins.append(caps - need)
    return bins


@pytest.mark.parametrize("p", [P.Params(), P.Params(documents=3), P.Params(weights=(0.2, 1.0, 3.0)), P.Params(score="dot"), P.Params(documents=4, score="dot", weights=(1.0, 0.5, 2.0))])
def test_plan_is_vector_best_fit_one_by_one(p):
    rng = random.Random(2)
    for _ in range(12):
        lengths = [min(2048, int(rng.paretovariate(0.7) * 20)) for _ in range(rng.randint(1, 250))]
        bins = laid_out(P.plan(Counter(lengths), p), Counter(lengths))
        expected = sorted(map(tuple, one_by_one(lengths, p)))
        found = sorted((p.tokens - sum(x for _, x in b), p.documents - len(b), p.attention - sum(x * x for _, x in b)) for b in bins.values())
        assert found == expected


def test_every_dimension_has_its_say():
    """With the registered weights, bins of equal tokens left are told apart, and the document limit binds."""
    counts = Counter([1000] * 2 + [500] * 4 + [20] * 6 + [1] * 400)
    bins = laid_out(P.plan(counts, P.Params()), counts)
    assert max(len(b) for b in bins.values()) == P.Params().documents
    lengths = Counter([1200, 600, 600, 800])
    placed = lambda w: sorted(sorted(x for _, x in b) for b in laid_out(P.plan(lengths, P.Params(weights=w)), lengths).values())
    assert placed((1.0, 0.0, 0.0)) == [[600, 600], [800, 1200]]


def test_a_piece_over_a_capacity_is_refused():
    with pytest.raises(ValueError, match="over a capacity"):
        P.plan({30: 1}, P.Params(attention=100))


def test_millions_of_pieces_take_few_rows():
    counts = {n: 10**9 // n for n in range(1, 2049)}
    # most pieces are of a few tokens, so that 128 to a sequence ask for some more sequences
    for p, over in ((P.Params(documents=2048), 1.0001), (P.Params(), 1.02)):
        rows = P.plan(counts, p)
        assert len(rows) < 20_000 and rows[:, 2].sum() == sum(counts.values())
        bins = int((rows[:, 4] + -(-rows[:, 2] // rows[:, 3])).max())
        assert bins <= over * -(-sum(k * n for k, n in counts.items()) // 2048)


def test_words_encode_as_whole_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    rng = random.Random(2)
    parts = ["don't", "'ll", "'", "re", "'S", "d", "v", "m", "t", "Ɓ", "²", "a", "É", "é", " ", "\n", "\t", "　", "'s", "’", "12", "ß", "Σ", "😀", "<|endoftext|>", "\x1c", "̸", "!?", "\xa0", "ING", "\r"]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [d[1] or "" for d in documents()]
    got = P.Encoder(tokenizer_path())(cases)
    for text, ids, e in zip(cases, got, t.encode_batch(cases, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, text


def test_caches_are_bounded_by_bytes_and_change_nothing(monkeypatch):
    monkeypatch.setattr(P, "CACHE_BYTES", 3000)
    monkeypatch.setattr(P, "PART_CHARS", 50)
    test_words_encode_as_whole_texts()
    e = P.Encoder(tokenizer_path())
    for i in range(40):
        e([" ".join(f"word{i}x{j}" for j in range(50)), "漢" * 400 + str(i)])
    assert len(e.ids) * 4 + len(e.hashes) * P.PLAIN_BYTES < 3000 + 50 * 100 and len(e.odd) < 10


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    given = json.loads(open(tokenizer_path(), encoding="utf-8").read())
    given["normalizer"]["normalizers"] = given["normalizer"]["normalizers"][:2]  # case is kept
    (tmp_path / "cased.json").write_text(json.dumps(given))
    t = Tokenizer.from_file(str(tmp_path / "cased.json"))
    e = P.Encoder(str(tmp_path / "cased.json"))
    cases = ["A bc DEF's", "", "é 12"]
    assert not e.known and P.Encoder(tokenizer_path()).known
    assert [np.frombuffer(x, "<u4").tolist() for x in e(cases)] == [x.ids for x in t.encode_batch(cases, add_special_tokens=False)]


def test_a_very_long_text_in_parts(monkeypatch):
    text = " ".join(f"Word{i % 97}" for i in range(3000)) + " 漢 " + "x" * 5000
    whole = P.Encoder(tokenizer_path())([text, text[:2000]])
    monkeypatch.setattr(P, "PART_CHARS", 100)
    assert P.Encoder(tokenizer_path())([text, text[:2000]]) == whole


@pytest.mark.parametrize("tokens, sent", [(2048, 10**6), (16, 10**6), (16, 0)])
def test_packing_round_trip(spark, docs, monkeypatch, tokens, sent):
    monkeypatch.setattr(P, "SENT_OFFSETS", sent)
    p = P.Params(tokens=tokens, documents=tokens, attention=tokens * tokens)
    rows = P.pack(docs, tokenizer_path(), p).collect()
    encode = P.Encoder(tokenizer_path())
    own = {d[0]: np.append(np.frombuffer(encode([d[1] or ""])[0], "<u4"), 0) for d in documents()}
    pieces = {}
    for r in rows:
        ids = own[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and r["start"] == r["piece"] * tokens and zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"]
        pieces.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, own.values()))
    for x in pieces.values():
        x.sort()
        assert x[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(x, x[1:], strict=False)) and x[-1][0] + x[-1][1] <= tokens


def test_packing_of_no_rows_repeated_rows_and_null_ids(spark, empty):
    assert P.pack(empty, tokenizer_path()).count() == 0
    same = spark.createDataFrame([(1, "a b")] * 3 + [(None, None)], "doc_id long, text string").withColumnRenamed("x", "length")
    rows = P.pack(same, tokenizer_path()).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 4 and {r["length"] for r in rows if r["doc_id"] is None} == {1}
