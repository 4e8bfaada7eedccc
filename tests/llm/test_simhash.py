import random

import numpy as np
import pytest
import xxhash
from fixtures import BYTES, documents, frame

from tessera.llm import simhash as S


def plain_fingerprint(text):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = BYTES.findall(lower)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(fp, ids, distance=4):
    parent = list(range(len(fp)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(fp))]


def test_classes_equal_brute_force(spark, docs):
    rows = documents()
    fp = [plain_fingerprint(r[1]) for r in rows]
    expected = dict(zip((r[0] for r in rows), zip((f"{x:016x}" for x in fp), plain_classes(fp, [r[0] for r in rows]), strict=True), strict=True))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.classes(docs).collect()} == expected


def clusters(n, seed=1):
    """Fingerprints around a few centres, at all small distances."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = set(centres)
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randint(1, 9)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("large, blocks", [(4096, 6), (7, 6), (50, 5), (4096, 7)])
def test_links_connect_what_all_pairs_connect(spark, large, blocks):
    """With buckets cut into pieces, long runs and short ones."""
    fp = clusters(400)
    signed = [x - (1 << 64) if x >> 63 else x for x in fp]
    edges = S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), S.Params(blocks=blocks), large)
    assert all(((r["u"] ^ r["v"]) & (2**64 - 1)).bit_count() <= 4 for r in edges.collect())
    found = {r["fp"]: r["root"] for r in S.components(edges).collect()}
    expected = plain_classes(fp, signed)
    assert [found.get(x, x) for x in signed] == expected


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(50)], [(0, i) for i in range(1, 40)], [(1, 2), (2, 3), (10, 11), (1, 3), (1, 2)]])
def test_components(spark, edges):
    found = {r["fp"]: r["root"] for r in S.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    ends = sorted({x for e in edges for x in e})
    parent = {x: x for x in ends}
    for _ in ends:
        for u, v in edges:
            parent[u] = parent[v] = min(parent[u], parent[v])
    assert found == parent


def test_forest_spans(spark):
    fp = np.array(clusters(300, 3), np.uint64)
    a, b = S.forest(fp, 4)
    assert len(a) < len(fp) and (np.bitwise_count(a ^ b) <= 4).all()


def test_representatives_and_edge_cases(spark, docs, empty, monkeypatch):
    assert S.classes(empty).count() == 0 == S.representatives(empty).count()
    classes = {r["doc_id"]: r["component_id"] for r in S.classes(docs).collect()}
    for limit in (S.SENT_IDS, 0):
        monkeypatch.setattr(S, "SENT_IDS", limit)
        kept = S.representatives(docs)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(classes.values())
    rows = [(None, "a b c d e", "en", "s", 0, 0), (7, "a b c d e", "en", "s", 0, 0), (7, "a b c d e", "en", "s", 0, 0), (None, "other words here now", "en", "s", 0, 0)]
    found = sorted((str(r["doc_id"]), str(r["component_id"])) for r in S.classes(frame(spark, rows)).collect())
    assert found == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]


def test_more_fingerprints_take_more_blocks():
    assert [S.blocks_for(n, 4) for n in (0, 10**9, 10**10, 10**12)] == [6, 6, 7, 8]
    for n in (10**6, 10**9, 10**12):
        blocks = S.blocks_for(n, 4)
        assert n / 2 ** (64 * (blocks - 4) // blocks) <= S.FULL + 1
