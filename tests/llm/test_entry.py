"""The registered queries, their twins and the pipeline, on the smallest tables."""

import pyarrow.dataset as ds
import pytest
from fixtures import base_counts
from test_line_dedup import brute as dedup
from test_near_copies import plain_kept

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import queries as Q


@pytest.fixture
def small(data_dir):
    return f"{data_dir}/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_twin(spark, compare, small, name):
    found, expected = compare(spark, small, entry.queries()[name], entry.oracle_sql()[name])
    assert found == expected


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_returns_a_row_per_document(spark, small, name):
    rows = entry.queries()[name](spark, small).toPandas()
    if name.startswith(("op7", "op8", "op10")):
        assert len(rows)
    else:
        assert sorted(rows["doc_id"]) == list(range(200))


def test_pipeline_stages(spark, small):
    docs, rows = Q.read(spark, small, "documents"), ds.dataset(f"{small}/documents.parquet").to_table().to_pylist()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    kept, stages = {}, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        stages.append({r["doc_id"]: r["text"] for r in docs.collect()})
        kept[name] = set(stages[-1])
    failed = {r["doc_id"] for r in rows if (b := base_counts(r["text"]))[0] < 20 or 100 * b[4] > 30 * b[0]}
    assert kept["quality rules"].isdisjoint(failed)
    plain = {d: t for d, t, _, _ in dedup([(d, t) for d, t in stages[0].items()])}
    assert stages[1] == plain
    ids = sorted(stages[1])
    assert kept["SimHash near-dedup"] == plain_kept([(d, stages[1][d]) for d in ids])
    items = [r["text"] for r in ds.dataset(f"{small}/benchmark.parquet").to_table().to_pylist()]
    assert kept["benchmark decontamination"] == {d for d, t in stages[2].items() if not any(i in t for i in items)}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r["doc_id"] for r in last} == kept["benchmark decontamination"]
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, small).collect())) == sorted(map(key, last))
