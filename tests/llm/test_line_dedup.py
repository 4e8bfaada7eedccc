import collections

import numpy as np
import pytest
from fixtures import SHARED, documents, frame
from pyspark.sql import types as T

from tessera.llm import line_dedup as D

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def key(line):
    return line.strip(BLANK).translate(LOWER)


def brute(rows, min_docs=5):
    holders = collections.defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(key(x), ())) >= min_docs and max(h) != r[0])]
        out.append((r[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def index(spark, docs, **params):
    return D.LineIndex.empty(spark, T.LongType(), D.Params(shards=4, **params)).insert(docs)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "text", "n_lines", "n_dropped").collect())


@pytest.mark.parametrize("limit", [0, 200, 1 << 20])
def test_equals_brute_force_on_every_path(spark, docs, limit):
    """Nothing broadcast, filters only, and all; the results are the same."""
    x = index(spark, docs, broadcast_bytes=limit)
    assert rows_of(x.apply(docs)) == brute(documents())
    assert brute(documents())[8][3] == 1


def test_deleting_restores_the_index(spark, docs):
    more = frame(spark, [(1000 + i, f"{SHARED}\nAnother line that several of the new documents have in common.", "en", "s", 0, 0) for i in range(6)])
    before = index(spark, docs)
    after = before.insert(more)
    assert rows_of(after.apply(docs)) == [r for r in brute(documents() + [tuple(r) for r in more.collect()]) if r[0] < 1000]
    restored = after.delete(more)
    table = lambda x, *c: sorted(tuple(r) for r in x.select(*c).collect())
    assert table(restored.refs, "k1", "k2", "doc_id", "n") == table(before.refs, "k1", "k2", "doc_id", "n")
    assert table(restored.repeated, "k1", "k2", "holder") == table(before.repeated, "k1", "k2", "holder")
    assert rows_of(restored.apply(docs)) == brute(documents())
    probe = lambda x: x.suspects(x.refs.select("k1", "k2", "doc_id")).count()
    assert probe(restored) == probe(before) < probe(after)


def test_a_row_deleted_once_of_two_stays(spark):
    rows = [(i, SHARED, "en", "s", 0, 0) for i in range(5)] + [(4, SHARED, "en", "s", 0, 0)]
    x = index(spark, frame(spark, rows)).delete(frame(spark, rows[-1:]))
    assert x.repeated.first()["holder"] == 4
    assert x.delete(frame(spark, rows[-1:])).repeated.count() == 0


def test_empty_null_ids_and_clashing_columns(spark, empty):
    assert index(spark, empty).apply(empty).count() == 0
    rows = [(None, SHARED, "en", "s", 0, 0)] * 2 + [(i, SHARED, "en", "s", 0, 0) for i in range(4)]
    docs = frame(spark, rows).withColumnRenamed("source", "n_lines").withColumnRenamed("lang", "k1")
    found = index(spark, docs).apply(docs).collect()
    assert sorted((r["doc_id"], r["n_dropped"]) for r in found if r["doc_id"] is not None) == [(0, 1), (1, 1), (2, 1), (3, 0)]
    assert [r["n_dropped"] for r in found if r["doc_id"] is None] == [1, 1]


def test_a_change_writes_only_the_shards_it_touches(spark, docs, monkeypatch):
    written = {}
    plain = D.table
    monkeypatch.setattr(D, "table", lambda df, name: written.setdefault(name, plain(df, name)))
    x = index(spark, docs)
    written.clear()
    line = "A line of one shard that four documents and one more have in common."
    after = x.insert(frame(spark, [(1000 + i, line, "en", "s", 0, 0) for i in range(5)]))
    (shard,) = {r["shard"] for r in written["delta"].collect()}
    for name in ("refs", "repeated", "filters"):
        assert {r["shard"] for r in written[name].collect()} == {shard}
    assert after.refs.count() == x.refs.count() + 5 and after.repeated.count() == x.repeated.count() + 1
    assert {r["shard"] for r in after.refs.collect()} >= {r["shard"] for r in x.refs.collect()}


def test_a_later_job_deletes_what_was_saved(spark, docs, tmp_path):
    more = frame(spark, [(1000 + i, SHARED, "en", "s", 0, 0) for i in range(6)])
    index(spark, docs).insert(more).save(f"file://{tmp_path}/index")
    again = D.LineIndex.load(spark, f"file://{tmp_path}/index")
    assert again.params == D.Params(shards=4)
    restored = again.delete(more)
    assert rows_of(restored.apply(docs)) == brute(documents())
    assert again.delete(docs).delete(more).refs.count() == 0


def test_filters_by_shard_and_whole_find_the_same(spark, docs):
    few, many = index(spark, docs, broadcast_bytes=0), index(spark, docs)
    found = lambda x: sorted(map(tuple, x.suspects(x.refs).collect()))
    assert found(few) == found(many) and 0 < len(found(few)) < few.refs.count()


def test_rewritten_rows_keep_their_columns(spark):
    docs = frame(spark, [(i, f"{SHARED}\n{i}", None, "s", i, 5) for i in range(6)]).withColumnRenamed("n_chars", "n_lines").withColumnRenamed("lang", "n_dropped").withColumnRenamed("source", "_row")
    found = index(spark, docs).rewritten(docs)
    assert found.columns == docs.columns
    assert sorted(tuple(r) for r in found.collect()) == sorted((i, f"{SHARED}\n5" if i == 5 else str(i), None, "s", i, 5) for i in range(6))


def test_string_ids(spark):
    docs = spark.createDataFrame([(c, SHARED) for c in "abcdef"], "doc_id string, text string")
    x = D.LineIndex.empty(spark, T.StringType()).insert(docs)
    assert sorted((r["doc_id"], r["n_dropped"]) for r in x.apply(docs).collect()) == [(c, int(c != "f")) for c in "abcdef"]


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    f = D.CuckooFilter(100)  # far too small: segments follow
    f.add(keys)
    assert f.contains(keys).all()
    others = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    assert f.contains(others).mean() < 0.01
    f.remove(keys[:10_000])
    assert f.contains(keys[10_000:]).all() and f.contains(keys[:10_000]).mean() < 0.01
    again = D.CuckooFilter(data=f.to_bytes())
    assert again.contains(keys[10_000:]).all()
    again.remove(keys[10_000:])
    assert not any(s.any() for s in again.segments)
